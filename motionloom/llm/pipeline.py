"""Training-data pipeline: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, folder of tables) and returns a frame. Its docs are the
written and reread result of the stage before, so a stage first deletes what the
operators of earlier stages left in the shared folder, unless its docs read it.

Cases, for all stages: null texts count as empty and stay null; null keys are kept
as rows of their own; repeated rows are single rows each, except in the stage that
removes near duplicates; an empty table gives an empty one; columns beyond COLUMNS
are left out; a table without rows of labels or benchmark items removes nothing.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.llm import common, decontam, packing, quality, shingles, suffix
from motionloom.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Folders that operators of earlier stages wrote.
_LEFT: list[str] = []


def _stage(one):
    @wraps(one)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT:
            in_use = docs.inputFiles()
            gone = [p for p in _LEFT if not any(p.split("/")[-1] in f for f in in_use)]
            common.delete(spark, gone)
            _LEFT[:] = [p for p in _LEFT if p not in gone]
            common.free_shuffles(spark)
        before = set(common.WRITTEN)
        out = one(spark, docs, sf_dir)
        _LEFT.extend(p for p in common.WRITTEN if p not in before)
        return out

    return run


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all, if there is nothing to learn from."""
    return quality.keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


@_stage
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked by SimHash (as op2_simhash links) or by 5-word
    Jaccard similarity 0.8 or more: the least by doc_id (null last), then by its text and other columns; of equal rows any, they are the same."""
    rows = shingles.prints(docs.select(*COLUMNS))
    order = F.struct(F.col("doc_id").isNull().alias("unkeyed"), "doc_id", F.xxhash64("text").alias("own"), F.xxhash64(*COLUMNS).alias("all"), "row")
    firsts = rows.select("row", order.alias("place")).join(shingles.classes(rows), "row").groupBy("class").agg(F.min("place").alias("place"))
    return rows.join(firsts.select("place.row"), "row", "left_semi").select(*COLUMNS)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; a document that
    had text and has none left goes; n_chars is counted anew."""
    return suffix.clean(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained models, suffix arrays and tokenizers are beyond SQL; tests/llm hold the stages against brute force or a round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over the documents of a folder of tables."""
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if last:
                common.discard(last)
            last = docs
    return docs
