"""Per-trial kernels as grouped functions: one Arrow transfer for each trial."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from motionloom.functions.scalars import c
from motionloom.operators import kernels as K
from motionloom.operators.windows import value_ranks

# By instrument, the shortest stroke (seconds, millimetres of path), the hands whose strokes are
# measured, and the signals and name of the smoothness feature; the joints and axes whose range is measured.
STROKE = {"violin": (0.15, 40.0), "clarinet": (0.10, 8.0), "default": (0.15, 20.0)}
HANDS = {"violin": ["RWrist"], "clarinet": ["RWrist", "LWrist"], "default": ["RWrist"]}
SMOOTH = {
    "violin": (["RElbowAngles_Y (deg)"], "SPARC_window_bow_elbow_all_median", "QC_SPARC_window_bow_elbow_all_n"),
    "clarinet": (["LWristPositions_X (mm)", "LWristPositions_Y (mm)", "LWristPositions_Z (mm)"], "SPARC_window_median_LWrist", "QC_SPARC_window_n_LWrist"),
}
JOINTS = ["Spine1Angles", "Spine2Angles", "Spine3Angles", "Spine4Angles", "NeckAngles", "HeadAngles", "RWristAngles", "RElbowAngles", "RShoulderAngles", "RClavicleAngles", "LWristAngles", "LElbowAngles", "LShoulderAngles", "LClavicleAngles"]
AXES = "XYZ"
POINT = "{}Positions_{} (mm)"


def _grouped(df: DataFrame, key: list[str], one, schema: str) -> DataFrame:
    """one(group) gives a dict of its columns; an error becomes a status, and the batch goes on."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = dict(zip(key, pdf[key].iloc[0].tolist(), strict=True)) | {n: None for n in names} | {"status": "ok", "error": None}
        try:
            row |= one(pdf)
        except Exception as e:
            row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([row])[[*key, *names, "status", "error"]]

    return df.groupBy(*key).applyInPandas(run, f"{kinds}, {schema}, status string, error string")


def _strokes(got, instrument: str) -> list[float]:
    v, fs = got
    return [j for a, z in K.strokes(v, fs, *STROKE[instrument]) if (j := K.log_jerk(v[a:z], fs)) is not None]


def movement(df: DataFrame, key: list[str], time: str, instrument: str, cutoff: float = 10.0) -> DataFrame:
    """Smoothness and stroke features of each trial, by what its instrument asks for.

    The clarinet's smoothness is of the left wrist's path, the violin's of the bow
    elbow's angle, others have none; signals a trial lacks give nulls and counts of 0.
    """
    wanted = [x for cols, *_ in SMOOTH.values() for x in cols] + [POINT.format(h, x) for h in ("RWrist", "LWrist") for x in AXES]
    have = [x for x in dict.fromkeys(wanted) if x in df.columns]
    names = {x: f"s{i}" for i, x in enumerate(have)}
    few = df.select(*key, F.col(time).alias("_t"), F.col(instrument).alias("_kind"), *(c(x).alias(n) for x, n in names.items()))

    def speed(pdf, cols):
        if not all(x in names for x in cols):
            return None
        return K.speed(pdf["_t"].to_numpy(float), pdf[[names[x] for x in cols]].to_numpy(float), cutoff)

    def one(pdf):
        kind, out = pdf["_kind"].iloc[0], {}
        kind = kind if kind in STROKE else "default"
        if kind in SMOOTH:
            cols, name, count = SMOOTH[kind]
            got = speed(pdf, cols)
            out[name], out[count] = K.window_sparc(*got) if got else (None, 0)
        for hand in HANDS[kind]:
            got = speed(pdf, [POINT.format(hand, x) for x in AXES])
            x = _strokes(got, kind) if got else []
            out |= {f"LDJ_stroke_mean_{hand}": float(np.mean(x)) if x else None, f"LDJ_stroke_sd_{hand}": float(np.std(x, ddof=1)) if len(x) > 1 else None, f"QC_LDJ_stroke_n_{hand}": len(x)}
        return out

    schema = [f"{name} double, {count} int" for _, name, count in SMOOTH.values()] + [f"LDJ_stroke_mean_{h} double, LDJ_stroke_sd_{h} double, QC_LDJ_stroke_n_{h} int" for h in ("RWrist", "LWrist")]
    return _grouped(few, key, one, ", ".join(schema))


def smoothness(df: DataFrame, key: list[str], time: str, signals: list[str], cutoff: float = 10.0) -> DataFrame:
    """Median window SPARC and the number of windows, of a point or an angle."""

    def one(pdf):
        got = K.speed(pdf[time].to_numpy(float), pdf[signals].to_numpy(float), cutoff)
        if got is None:
            return {"n_windows": 0}
        m, n = K.window_sparc(*got)
        return {"sparc": m, "n_windows": n}

    return _grouped(df.select(*key, time, *signals), key, one, "sparc double, n_windows int")


def window_smoothness(df: DataFrame, key: list[str], time: str, speed: str) -> DataFrame:
    """Median window SPARC of a column that holds speeds already, at a uniform rate."""

    def one(pdf):
        pdf = pdf.sort_values(time, kind="stable")
        m, n = K.window_sparc(pdf[speed].to_numpy(float), 1 / float(np.median(np.diff(pdf[time].to_numpy(float)))))
        return {"sparc": m, "n_windows": n}

    return _grouped(df.select(*key, time, speed), key, one, "sparc double, n_windows int")


def whole_jerk(df: DataFrame, key: list[str], order: str, speed: str, fs: float = 50.0) -> DataFrame:
    """Logarithmic dimensionless jerk of a group's speeds as one stroke."""
    return _grouped(df.select(*key, order, speed), key, lambda pdf: {"ldj": K.log_jerk(pdf.sort_values(order, kind="stable")[speed].to_numpy(float), fs)}, "ldj double")


def stroke_jerk(df: DataFrame, key: list[str], time: str, signals: list[str], instrument: str = "default", cutoff: float = 10.0) -> DataFrame:
    """Mean, SD and number of stroke LDJ values."""

    def one(pdf):
        got = K.speed(pdf[time].to_numpy(float), pdf[signals].to_numpy(float), cutoff)
        if got is None:
            return {"n_strokes": 0}
        x = _strokes(got, instrument)
        return {"ldj_mean": float(np.mean(x)) if x else None, "ldj_sd": float(np.std(x, ddof=1)) if len(x) > 1 else None, "n_strokes": len(x)}

    return _grouped(df.select(*key, time, *signals), key, one, "ldj_mean double, ldj_sd double, n_strokes int")


def filtered(df: DataFrame, key: list[str], order: str, cutoffs: dict[str, float], fs: float = 50.0) -> DataFrame:
    """Zero-phase low-pass of each signal with its cutoff, in one pass over a trial's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").copy()
        for hz in sorted(set(cutoffs.values())):
            cols = [c for c, v in cutoffs.items() if v == hz]
            pdf[cols] = K.zero_phase(pdf[cols].to_numpy(float), hz, fs)
        return pdf

    return df.groupBy(*key).applyInPandas(run, df.schema)


def cleaned(df: DataFrame, key: list[str], order: str, cutoffs: dict[str, float], gap: int = 5, fs: float = 50.0, log: str = "_log") -> DataFrame:
    """Gap-filled and filtered trials, each with one row more that holds its log as JSON.

    Signals are filled by place, at most `gap` deep, and filtered if no gap remains and
    the trial is long enough. A trial that fails gives a log row with the error only.
    """
    signals = list(cutoffs)

    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = dict(zip(key, pdf[key].iloc[0].tolist(), strict=True))
        note = {"n_rows": len(pdf), "nan_before": 0, "nan_after": 0, "skipped_nan": 0, "skipped_short": 0, "cutoffs": [], "error": None}
        try:
            pdf = pdf.sort_values(order, kind="stable", na_position="last").copy()
            has = [x for x in signals if pdf[x].notna().any()]
            note["nan_before"] = int(pdf[has].isna().sum().sum())
            x = pdf[has].astype(float)
            if note["nan_before"]:
                x = x.interpolate(method="linear", limit=gap, limit_direction="both")
            note["nan_after"] = int(x.isna().sum().sum())
            whole = [n for n in has if not x[n].isna().any()]
            note["skipped_nan"] = len(has) - len(whole)
            done = []
            for hz in sorted({cutoffs[n] for n in whole}):
                cols = [n for n in whole if cutoffs[n] == hz]
                if len(x) > 15:
                    x[cols] = K.zero_phase(x[cols].to_numpy(float), hz, fs)
                    done.append(hz)
                else:
                    note["skipped_short"] += len(cols)
            note["cutoffs"] = done
            pdf[has] = x
        except Exception as e:
            pdf, note["error"] = pdf.iloc[:0].copy(), f"{type(e).__name__}: {e}"
        pdf[log] = None
        return pd.concat([pdf, pd.DataFrame([first | {log: json.dumps(note)}])], ignore_index=True)[[*names, log]]

    return df.groupBy(*key).applyInPandas(run, StructType([*(StructField(f.name, f.dataType) for f in df.schema), StructField(log, StringType())]))


def mutual_information(long: DataFrame, label: str, seed: int = 42, k: int = 3, rows: int = 1 << 17) -> DataFrame:
    """(feature, mutual_info) from (feature, value, label): the nearest-neighbour estimate of kernels.mutual_information,
    over features of any size; null under ten values or two classes.

    Different values of a class are counted, and ranked into slices of up to twice `rows` numbers,
    also where one value has more. A task spreads the equal values of its slice by the estimate's small noise,
    in an order and with a seed of the slice's own, and counts. Numbers whose neighbourhood leaves
    the slice, a few for each class and slice, go to the driver; it finds their distances from the
    k outermost numbers of each class and slice, and a second pass counts in the slices where these end.
    """
    spark = long.sparkSession
    every = long.groupBy("feature", F.col("value").cast("double").alias("value"), F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.DISK_ONLY)
    try:
        x, w = F.col("value"), F.col("c")
        names = [r[0] for r in every.select("feature").distinct().collect()]
        valid = every.where("value is not null and not isnan(value) and y is not null")
        sums = valid.groupBy("feature", "y").agg(F.sum("c").alias("n"), F.sum(w * x).alias("s"), F.sum(w * F.abs(x)).alias("a"), F.sum(w * x * x).alias("q")).collect()
        classes: dict[str, list] = {}
        for r in sums:
            classes.setdefault(r["feature"], []).append(r)
        made = {f: (None, {}) for f in names}
        for f, all_of in classes.items():
            kept = sorted((r for r in all_of if r["n"] > 1), key=lambda r: r["y"])
            if sum(r["n"] for r in all_of) < 10 or len(all_of) < 2 or not all(np.isfinite(r["q"]) for r in all_of):
                continue
            n = sum(r["n"] for r in kept)
            s, a, q = (sum(r[z] for r in kept) / max(n, 1) for z in "saq")
            sd = max(q - s * s, 0.0) ** 0.5
            made[f] = (n, {"labels": [r["y"] for r in kept], "sizes": np.array([r["n"] for r in kept], np.int64), "noise": 12**0.5 * 1e-10 * max(sd if sd > 0 else 1.0, a)})
        of = {f: m for f, (n, m) in made.items() if n}
        codes = [(f, y, i, int(m["sizes"].sum())) for f, m in of.items() for i, y in enumerate(m["labels"])]
        if not codes:
            return spark.createDataFrame([(f, None if n is None else 0.0) for f, (n, _) in made.items()], "feature string, mutual_info double")
        counts = valid.join(F.broadcast(spark.createDataFrame(codes, "feature string, y string, code int, n long")), ["feature", "y"])
        ranks = value_ranks(counts.groupBy("feature", "value").agg(F.sum("c").alias("t")), ["feature"], "value", "t")
        cells = counts.join(ranks, ["feature", "value"])
        # a value of more rows than a slice has slices of its own; the values before it in its range keep theirs
        parts = F.when(F.col("t") > rows, F.ceil(F.col("t") / rows)).otherwise(1).cast("int")
        cells = cells.withColumns({"range": F.floor((F.col("upto") - F.col("t")) / rows).cast("long"), "parts": parts, "part": F.explode(F.sequence(F.lit(0), parts - 1))})
        own = F.floor(F.col("c") / F.col("parts")) + (F.col("part") < F.col("c") % F.col("parts")).cast("long")
        cells = cells.select("feature", "range", F.when(F.col("parts") > 1, F.col("part") + 1).otherwise(0).alias("sub"), "value", "code", own.cast("long").alias("c"), "part", "parts", (F.col("upto") == F.col("t")).alias("first"), (F.col("upto") == F.col("n")).alias("last"))
        cells = cells.where("c > 0").persist(StorageLevel.DISK_ONLY)
        try:
            return spark.createDataFrame(list(_information(spark, cells, made, of, seed, k)), "feature string, mutual_info double")
        finally:
            cells.unpersist()
    finally:
        every.unpersist()


def _spread(pdf: pd.DataFrame, noise: float, seed: int):
    """A slice's numbers in order: value, noise, class, place from the slice's first one, and whether it is the feature's first or last slice."""
    pdf = pdf.sort_values(["value", "code"], kind="stable")
    c = pdf["c"].to_numpy()
    value, code, part, parts = (np.repeat(pdf[z].to_numpy(), c) for z in ("value", "code", "part", "parts"))
    key = zlib.crc32(f"{seed} {pdf['feature'].iloc[0]} {pdf['range'].iloc[0]} {pdf['sub'].iloc[0]}".encode())
    off = ((part + np.random.default_rng(key).random(len(value))) / parts - 0.5) * noise
    at = (value - value[0]) + (off - off[0])
    order = np.argsort(at, kind="stable")
    value, off, code = value[order], off[order], code[order]
    first = pdf["first"].any() and pdf["part"].iloc[0] == 0
    last = bool((pdf["last"] & (pdf["part"] == pdf["parts"] - 1)).any())
    return value, off, code, (value - value[0]) + (off - off[0]), first, last


def _information(spark, cells: DataFrame, made: dict, of: dict, seed: int, k: int):
    known = spark.sparkContext.broadcast({f: (m["noise"], np.minimum(k, m["sizes"] - 1)) for f, m in of.items()})
    keys = ["feature", "range", "sub"]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        noise, counted = known.value[pdf["feature"].iloc[0]]
        value, off, code, at, first, last = _spread(pdf, noise, seed)
        m, rest, sides = K.slice_neighbours(at, code, counted, k, first, last)
        ends = []
        for c in np.unique(code):
            own = np.flatnonzero(code == c)
            ends += [np.column_stack([np.full(len(i), c), np.full(len(i), s), value[i], off[i]]) for s, i in ((0, own[:k]), (1, own[-k:]))]
        rows_ = np.column_stack([value, off, code, sides])[rest]
        return pd.DataFrame([{**pdf[keys].iloc[0].to_dict(), "n": len(at), "psi": float(K.digamma(m[~rest]).sum()), "value": value[0], "off": off[0], "ends": np.concatenate(ends).tobytes(), "rest": rows_.tobytes()}])

    slices = cells.groupBy(*keys).applyInPandas(near, "feature string, range long, sub int, n long, psi double, value double, off double, ends binary, rest binary").collect()
    total = dict.fromkeys(of, 0.0)
    asked: dict[tuple, list] = {}
    waiting: dict[str, np.ndarray] = {}
    for f, m in of.items():
        mine = sorted((r for r in slices if r["feature"] == f), key=lambda r: (r["range"], r["sub"]))
        total[f] = sum(r["psi"] for r in mine)
        start = np.concatenate([[0], np.cumsum([r["n"] for r in mine])])
        ends = [np.frombuffer(r["ends"]).reshape(-1, 4) for r in mine]
        outer = {}  # of each class, first and last numbers by slice
        for s, e in enumerate(ends):
            for c, side, value, off in e:
                outer.setdefault((int(c), int(side)), []).append((s, value, off))
        outer = {z: np.array(e) for z, e in outer.items()}
        heads = np.array([[r["value"], r["off"]] for r in mine])
        counted = np.minimum(k, m["sizes"] - 1)
        ranks = []
        for s, r in enumerate(mine):
            for row in np.frombuffer(r["rest"]).reshape(-1, 3 + 2 * k):
                value, off, c = row[0], row[1], int(row[2])
                d = [row[3:][np.isfinite(row[3:])]]
                before, after = outer[c, 1], outer[c, 0]
                i, j = np.searchsorted(before[:, 0], s), np.searchsorted(after[:, 0], s, "right")
                for e, sign in ((before[max(0, i - k) : i], 1), (after[j : j + k], -1)):
                    d.append(sign * ((value - e[:, 1]) + (off - e[:, 2])))
                d = np.sort(np.concatenate(d))[counted[c] - 1] * (1 - 1e-12)
                for sign in (-1, 1):
                    to = off + sign * d
                    t = max(0, int((((heads[:, 0] - value) + (heads[:, 1] - to)) <= 0).sum()) - 1)
                    asked.setdefault((f, mine[t]["range"], mine[t]["sub"]), []).append((len(ranks), value, to, sign))
                    ranks.append(start[t])
        waiting[f] = np.array(ranks, np.int64)
    if asked:
        questions = spark.sparkContext.broadcast({z: np.array(q) for z, q in asked.items()})
        wanted = spark.createDataFrame(list(asked), "feature string, range long, sub int")

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            f, a, b = pdf[keys].iloc[0]
            value, off, _, at, _, _ = _spread(pdf, known.value[f][0], seed)
            q = questions.value[f, a, b]
            to = (q[:, 1] - value[0]) + (q[:, 2] - off[0])
            n = np.where(q[:, 3] < 0, np.searchsorted(at, to, "left"), np.searchsorted(at, to, "right"))
            return pd.DataFrame({"feature": f, "i": q[:, 0].astype(np.int64), "n": n})

        for r in cells.join(F.broadcast(wanted), keys, "left_semi").groupBy(*keys).applyInPandas(count, "feature string, i long, n long").collect():
            waiting[r["feature"]][r["i"]] += r["n"]
        questions.destroy()
    for f, (n, m) in made.items():
        if n:
            ranks = waiting[f].reshape(-1, 2)
            psi = total[f] + K.digamma(np.maximum(ranks[:, 1] - ranks[:, 0], 1)).sum()
            size = m["sizes"]
            yield f, float(max(0.0, K.digamma(n) + (size * (K.digamma(np.minimum(k, size - 1)) - K.digamma(size))).sum() / n - psi / n))
        else:
            yield f, None if n is None else 0.0
    known.destroy()
