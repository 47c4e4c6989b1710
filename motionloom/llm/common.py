"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where the session names none and its master is local a temporary folder is
    made and kept in the setting, so one session uses one folder; on a cluster a
    missing setting is an error.
    """
    path = spark.conf.get(CHECKPOINT, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="motionloom-")
        spark.conf.set(CHECKPOINT, path)
    return path.rstrip("/")


#: Folders of the tables that materialize() wrote and that still stand.
WRITTEN: list[str] = []


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes at the end of the driver, if not before."""
    path = f"{shared_dir(spark)}/motionloom/{tag}-{uuid.uuid4().hex}"
    files, p = _folder(spark, path)
    files.deleteOnExit(p)
    WRITTEN.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and return the reread table (lineage is cut).

    Lazy results may read it at any later time; it goes at the end of the driver
    unless discard() or delete() took it before.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._motionloom_path = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that materialize() wrote."""
    for path in paths:
        files, p = _folder(spark, path)
        files.delete(p, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later result reads."""
    for df in tables:
        delete(df.sparkSession, [p for p in [getattr(df, "_motionloom_path", None)] if p])


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of finished, unreferenced jobs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def deals(spark: SparkSession, least: int = 1) -> int:
    """Number of hash partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about 4 MB, since one text may be very long.

    Frames are lazy and the setting is the session's, so every operator asks for the
    same value, and none depends on which was called last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text (null: empty) of every row, and nothing else."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def trim() -> None:
    """Give freed memory of a worker back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def bulks(batches, least: int = 4 << 20):
    """Arrow batches put together until they hold `least` bytes."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        del held
        trim()


def column(table, name: str):
    """A column of a combined table as one array."""
    import pyarrow as pa

    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
