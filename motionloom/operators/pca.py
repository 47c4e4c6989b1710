"""Principal movements: shared and per-block components, consistency and variability."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.operators.kernels import first_loading


def finite_rows(df: DataFrame, key: list[str], vector: str, least: int = 10) -> DataFrame:
    """Frames whose signals are all finite, of blocks with at least `least` of them."""
    good = df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return good.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where(F.col("_n") >= least).drop("_n")


def signals_long(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    return df.select(*key, F.posexplode(vector).alias("signal", "value"))


def temporal_sd(long: DataFrame, key: list[str]) -> DataFrame:
    return long.groupBy(*key, "signal").agg(F.stddev_samp("value").alias("temporal_sd"))


def family_means(sds: DataFrame, key: list[str], family: Column, families: list[str]) -> DataFrame:
    """Mean SD of each family as columns; rows with a null key are left out."""
    for k in key:
        sds = sds.where(F.col(k).isNotNull())
    out = sds.withColumn("_family", family).groupBy(*key).pivot("_family", families).agg(F.avg("temporal_sd"))
    return out.select(*key, *(F.col(f).alias(f"{f}_mean_sd") for f in families))


def normalized(df: DataFrame, key: list[str], row: str, vector: str) -> DataFrame:
    """(key, row, signal, value): block's channel means removed, divided by one SD of all its cells."""
    long = df.select(*key, row, F.posexplode(vector).alias("signal", "value"))
    scale = long.groupBy(*key).agg(F.stddev_pop("value").alias("_sd")).where("_sd > 0 and not isnan(_sd)")
    means = long.groupBy(*key, "signal").agg(F.avg("value").alias("_m"))
    return long.join(means, [*key, "signal"]).join(scale, key).select(*key, row, "signal", ((F.col("value") - F.col("_m")) / F.col("_sd")).alias("value"))


def gram(df: DataFrame, vector: str, n: int, by: str | None = None) -> DataFrame:
    """(by, pos, sum): sums of products of the vectors' cells, each vector with a 1 at its end.

    Each Arrow batch gives one (n + 1) by (n + 1) matrix for each value of `by` in it, row after row.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            which = np.array(batch.column(1).to_pylist())
            kinds = np.unique(which)
            yield pa.RecordBatch.from_pydict({"by": pa.array(kinds, pa.int32()), "g": pa.array([(x[which == k].T @ x[which == k]).ravel() for k in kinds], pa.list_(pa.float64()))})

    rows = df.select(F.col(vector).cast("array<double>"), (F.col(by) if by else F.lit(0)).cast("int").alias("by"))
    return rows.mapInArrow(run, "by int, g array<double>").select("by", F.posexplode("g").alias("pos", "x")).groupBy("by", "pos").agg(F.sum("x").alias("sum"))


def covariance(long: DataFrame, key: list[str], row: str, n: int) -> DataFrame:
    """(i, j, cov) of the signals over all frames, with population weight, from one matrix of sums a batch."""
    vec = long.groupBy(*key, row).agg(F.array_sort(F.collect_list(F.struct("signal", "value"))).alias("v")).select(F.transform("v", lambda s: s["value"]).alias("v"))
    g = gram(vec, "v", n)
    # (n + 1)^2 numbers, in one row
    one = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sum"))), lambda s: s["sum"]).alias("g"))
    cells = one.select("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("g", "i", F.explode(F.sequence("i", F.lit(n - 1))).alias("j"))
    at = lambda i, j: F.get("g", i * (n + 1) + j)
    i, j, count = F.col("i"), F.col("j"), F.get("g", F.lit((n + 1) ** 2 - 1))
    return cells.select("i", "j", (at(i, j) / count - at(i, F.lit(n)) / count * at(j, F.lit(n)) / count).alias("cov")).where("cov is not null")


def shared_components(cov: DataFrame, means: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Explained shares and directions (rows) from the n by n covariance, which is small."""
    m = np.zeros((n, n))
    for r in cov.collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    val, vec = np.linalg.eigh(m)
    val, vec = np.maximum(val[::-1], 0), vec[:, ::-1].T
    sign = np.sign(vec[np.arange(n), np.abs(vec).argmax(axis=1)])
    return val / max(val.sum(), 1e-300), vec * sign[:, None]


def loadings(spark, share: np.ndarray, vec: np.ndarray) -> DataFrame:
    rows = [(k + 1, float(s), float(c), [float(x) for x in v]) for k, (s, c, v) in enumerate(zip(share, np.cumsum(share), vec, strict=True))]
    return spark.createDataFrame(rows, "pm int, variance_explained double, cumulative double, loading array<double>")


def components_needed(share: np.ndarray, target: float) -> int:
    return int(np.searchsorted(np.cumsum(share), target - 1e-12) + 1)


def scores(long: DataFrame, key: list[str], row: str, vec: np.ndarray, most: int = 25) -> DataFrame:
    """(key, row, pm, score) of each frame on the leading components; blocks are centred, so means are 0."""
    kept = [[float(x) for x in v] for v in vec[:most]]
    frames = long.groupBy(*key, row).agg(F.array_sort(F.collect_list(F.struct("signal", "value"))).alias("v")).select(*key, row, F.transform("v", lambda s: s["value"]).alias("v"))
    table = F.array(*(F.array(*(F.lit(x) for x in v)) for v in kept))
    out = frames.select(*key, row, F.posexplode(F.transform(table, lambda w: F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))).alias("pm", "score"))
    return out.withColumn("pm", F.col("pm") + 1)


def usage(long: DataFrame, key: list[str], row: str, vec: np.ndarray, most: int = 25) -> DataFrame:
    """(key, pm, rms): root mean square score of each block on the leading components."""
    return scores(long, key, row, vec, most).groupBy(*key, "pm").agg(F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("rms"))


def summary(spark, share: np.ndarray, n_signals: int, n_blocks: int, detail: int = 25, shown: int = 7) -> DataFrame:
    """One row: signals, blocks, components for 90 and 95 % of the variance, saved and shown components."""
    row = (n_signals, n_blocks, components_needed(share, 0.90), components_needed(share, 0.95), min(detail, len(share)), min(shown, len(share)))
    return spark.createDataFrame([row], "n_curated_signals int, n_blocks int, n_pm_90 int, n_pm_95 int, n_pm_detail_saved int, n_pm_primary_evaluation int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def block_loadings(df: DataFrame, key: list[str], row: str, vector: str) -> DataFrame:
    """(key, loading): first direction of each block; a block is a bounded number of frames."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = first_loading(np.stack(pdf.sort_values(row)[vector].to_numpy()).astype(float))
        return pd.DataFrame([] if v is None else [[*pdf[key].iloc[0].tolist(), v.tolist()]], columns=[*key, "loading"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, row, vector).groupBy(*key).applyInPandas(one, f"{kinds}, loading array<double>")


def aligned(blocks: DataFrame, participant: list[str], order: str) -> DataFrame:
    """Loadings with the sign of the participant's first block."""
    w = Window.partitionBy(*participant).orderBy(order)
    first = F.first("loading").over(w)
    return blocks.withColumn("loading", F.when(dot(F.col("loading"), first) < 0, F.transform("loading", lambda x: -x)).otherwise(F.col("loading")))


def consistency(blocks: DataFrame, participant: list[str], order: str) -> DataFrame:
    """Mean and SD of cosines between a participant's blocks; one block is left out."""
    a, b = blocks.alias("a"), blocks.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in participant])
    p = a.join(b, same & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    got = p.groupBy(*(F.col(f"a.{k}").alias(k) for k in participant)).agg(F.avg(cosine(F.col("a.loading"), F.col("b.loading"))).alias("consistency"), F.stddev_samp(cosine(F.col("a.loading"), F.col("b.loading"))).alias("consistency_sd"))
    return got.join(blocks.groupBy(*participant).agg(F.count("*").alias("n_blocks")), participant)
