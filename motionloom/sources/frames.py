"""Sources and sinks of trials, metadata and reports."""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from motionloom.functions.scalars import c, canonical_label, condition, nulls_for_nan, participant

# The nominal width and rate of a trial, columns that are no signals, and cutoffs (Hz) by name pattern.
WIDTH, RATE, DEFAULT_CUTOFF = 199, 50.0, 6.0
NOT_SIGNALS = {"n_placeholders", "time_s", "participant_id", "condition", "block", "Timestamp", "Frame", "Sub Frame"}
REQUIRED = ["ID", "Instrument", "Skill Level", "Num Level", "Age", "Sex"]
TRIAL_NAME = r"^(P\d+)_([a-zA-Z]+)_(\d+)"
CUTOFFS = [
    (r"(?i)wrist|hand|finger|thumb", 9.0),
    (r"(?i)toe", 8.0),
    (r"(?i)elbow|forearm", 8.0),
    (r"(?i)shoulder|clavicle|arm", 8.0),
    (r"(?i)hip|pelvis|thigh|knee|ankle|foot", 6.0),
    (r"(?i)frontal plane (knee|projection) angle|\(deg\)\.1|\(ratio\)\.1", 6.0),
    (r"(?i)spine|trunk|chest|neck|head|nose|ear|centerofgravity", 2.0),
]


def header_names(line: str) -> list[str]:
    """Stripped names; the second `a` is `a.1`, the third `a.2`."""
    seen: dict[str, int] = {}
    out = []
    for n in next(csv.reader([line])):
        n = n.strip()
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def trial_keys(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows with participant_id, condition and block from the file name, and those whose name doesn't tell."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_clean$", "")
    k = df.withColumns({"participant_id": F.upper(F.regexp_extract(stem, TRIAL_NAME, 1)), "condition": F.lower(F.regexp_extract(stem, TRIAL_NAME, 2)), "block": F.regexp_extract(stem, TRIAL_NAME, 3).try_cast("int")})
    return k.where("block is not null"), k.where("block is null").select(path).distinct()


def read_trials(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All trials under a folder, cleaned of padding and placeholder columns, in one wide table.

    Files of one header are read together; headers are few and are found from the files' first lines.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).withColumn("path", F.input_file_name())
    heads = lines.where("length(value) > 0").groupBy("path").agg(F.first("value").alias("head")).groupBy("head").agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for r in sorted(heads, key=lambda r: r["head"]):
        names = header_names(r["head"])
        raw = spark.read.schema(", ".join(f"c{i} string" for i in range(len(names)))).option("header", True).option("enforceSchema", True).csv(r["paths"]).withColumn("path", F.input_file_name())
        keep = [(i, n) for i, n in enumerate(names) if n != "Annotations" and not re.match(r"^\(.*\)$", n)]
        text = {"participant_id", "condition", "block", "Timestamp"}
        notes = [F.lit("Annotations" in names).alias("had_annotations"), F.lit(sum(bool(re.match(r"^\(.*\)$", n)) for n in names)).alias("n_placeholders")]
        df = raw.select("path", *notes, *((F.col(f"c{i}") if n in text else F.col(f"c{i}").try_cast("double")).alias(n) for i, n in keep))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return nulls_for_nan(out) if out is not None else None


def signal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if re.search("Position|Angle", f.name) and isinstance(f.dataType, NumericType) and f.name not in NOT_SIGNALS]


def cutoff_map(given: str | dict | None) -> list[tuple[str, float]]:
    """Ordered (pattern, Hz) from a JSON file or a mapping; the usual joint groups if there is none."""
    if not given:
        return CUTOFFS
    if isinstance(given, str):
        with open(given) as f:
            given = json.load(f)
    return [(k, float(v)) for k, v in given.items()]


def cutoff(name: str, table: list[tuple[str, float]], default: float = DEFAULT_CUTOFF) -> float:
    """The first pattern that is found in the name decides."""
    return next((hz for p, hz in table if re.search(p, name)), default)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".xls", ".xlsx")):
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(path))
        except ImportError as e:
            raise ValueError("spreadsheets need an Excel reader; save the table as CSV or Parquet") from e
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def metadata(df: DataFrame) -> DataFrame:
    """Participants with checked columns and unique ids; other columns are ignored."""
    lack = [x for x in REQUIRED if x not in df.columns]
    if lack:
        raise ValueError(f"metadata lacks {lack}")
    m = df.select(participant(F.col("ID")).alias("participant_id"), *(c(x) for x in REQUIRED[1:])).where("participant_id is not null and participant_id <> ''")
    bad = m.groupBy("participant_id").count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"duplicate ids {[r[0] for r in bad]}")
    return m


def tolerant_metadata(df: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(participant_id, instrument, skill): columns found by parts of their names; an absent table is empty.

    instrument is as written, in lower case; skill is the canonical label.
    """
    if df is None:
        return spark.createDataFrame([], "participant_id string, instrument string, skill string")
    low = {x.strip().lower(): x for x in df.columns}
    find = lambda part: next((x for k, x in low.items() if part in k), None)
    key, inst, skill = low.get("id", df.columns[0]), find("instrument"), find("skill")
    none = F.lit(None).cast("string")
    m = df.select(participant(c(key)).alias("participant_id"), condition(c(inst) if inst else none).alias("instrument"), (canonical_label(c(skill)) if skill else none).alias("skill"))
    return m.where("participant_id <> ''").groupBy("participant_id").agg(F.min(F.struct("instrument", "skill")).alias("m")).select("participant_id", "m.*")


def write_report(df: DataFrame, folder: str, scope: str | None = None, as_csv: bool = False) -> None:
    """Parquet (and CSV) of a report; the scope is a column, not a file prefix."""
    if scope is not None:
        df = df.withColumn("scope", F.lit(scope))
    df.write.mode("overwrite").parquet(folder)
    if as_csv:
        flat = [F.to_json(c(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else c(f.name) for f in df.schema]
        df.sparkSession.read.parquet(folder).select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(folder.rstrip("/") + "_csv")


def write_json(df: DataFrame, folder: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_other_folder(source: str, target: str) -> None:
    norm = lambda p: re.sub(r"^file:/+", "/", p).rstrip("/")
    if norm(source) == norm(target):
        raise ValueError("the output folder is the input folder")
