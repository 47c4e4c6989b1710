"""Token ids in a compact file format: canonical length-limited Huffman codes.

Documents are sorted into ranges of ascending key and tokenized once; blocks of
consecutive documents hold their ids and the counts of these, which over all give one
canonical code of at most MAX_BITS bits (package-merge). Each block is coded by
itself, with the bit offset of every STEP-th id, so a reader starts anywhere and
decodes all stretches of a block side by side with one table.

The files are a folder of two Parquet tables: `code`, the code length of each id, from
which the canonical code follows, and `blocks`, the coded blocks with their documents'
keys. A reader needs nothing but the folder.

Cases: null or empty text: only the end id; null keys come first; repeated rows
are coded each; empty table: no blocks, no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.llm import tokens as T
from motionloom.llm.common import bounded_batches, bulks, column, deals, discard, free_shuffles, materialize, scratch, texts

MAX_BITS, STEP, BLOCK_IDS = 18, 256, 1 << 20
MAGIC = b"MLHUF001"
HEAD = struct.Struct("<8sIIQQ")  # magic, documents, step, ids, bytes of code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    # level by level: weights, and of which leaves or packages (indices into the level before)
    levels, weight, source = [], leaf, np.arange(len(leaf))
    levels.append(source)
    n = len(leaf)
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        source = np.argsort(both, kind="stable")
        weight = both[source]
        levels.append(source)
    take = 2 * n - 2  # items taken of the last level
    depth = np.zeros(n, np.int64)
    for source in reversed(levels):
        got = source[:take]
        depth[got[got < n]] += 1
        take = 2 * int((got >= n).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, and by symbol within a length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        ln = lengths[order].astype(np.int64)
        room = 1 << (MAX_BITS - ln)
        codes[order] = ((np.cumsum(room) - room) >> (MAX_BITS - ln)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each MAX_BITS bits: symbol * 32 + length of the code they begin with."""
    table = np.zeros(1 << MAX_BITS, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    filled = np.repeat(order.astype(np.int64) * 32 + lengths[order], 1 << (MAX_BITS - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table


def encode_block(ids: np.ndarray, lens: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block: head, ids of each document, bit offsets, code bits."""
    ln = lengths[ids].astype(np.int64)
    ends = np.cumsum(ln)
    at = ends - ln
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    if len(ids):
        w, placed = at >> 5, codes[ids] << (64 - ln - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        words[w[first]] += np.add.reduceat(placed >> np.uint64(32), first)
        words[w[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    bits = words.astype(">u4").tobytes()
    marks = at[::STEP].astype("<u8").tobytes()
    return HEAD.pack(MAGIC, len(lens), STEP, len(ids), len(bits)) + lens.astype("<u8").tobytes() + marks + bits


def decode_block(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block, and how many each document has."""
    magic, docs, step, n, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of coded ids")
    at = HEAD.size
    lens = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    lanes = -(-n // step)
    marks = np.frombuffer(data, "<u8", lanes, at + 8 * docs).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, size, at + 8 * docs + 8 * lanes).astype(np.uint32)
    if not n:
        return np.zeros(0, np.uint32), lens
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    window = window.astype(np.int64)
    out, p, last = np.zeros((step, lanes), np.uint32), marks.copy(), len(window) - 1
    mask = (1 << MAX_BITS) - 1
    for j in range(step):
        found = table[(window[np.minimum(p >> 3, last)] >> (32 - MAX_BITS - (p & 7))) & mask]
        out[j] = found >> 5
        p += found & 31
    return out.T.reshape(-1)[:n], lens


CODED = "shard int, block int, doc_ids binary, no_id binary, n_docs long, n_tokens long, coded binary"
BLOCKS = "shard int, block int, doc_ids binary, no_id binary, n_docs long, n_tokens long, ids binary, counts binary"


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, if they fit."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _ids_of(raw: bytes, docs: int, n: int) -> np.ndarray:
    """The n ids of an uncoded block, behind the lengths of its documents."""
    return np.frombuffer(raw, "<u2" if len(raw) - 8 * docs == 2 * n else "<u4", n, 8 * docs)


def _tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches):
        shard = TaskContext.get().partitionId()
        encoder, block = T.encoder(path), 0
        for table in bulks(batches, 6 << 20):
            ids, lens = encoder.encode(column(table, "text"))
            ends = np.cumsum(lens)
            ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
            lens = lens + 1
            ends = np.cumsum(lens)
            keys = column(table, "doc_id")
            none = keys.is_null().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            a = 0
            while a < len(lens):
                base = ends[a] - lens[a]
                b = max(a + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                part = ids[base : ends[b - 1]]
                total = np.bincount(part)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "block": pa.array([block], pa.int32()),
                        "doc_ids": [keys[a:b].astype("<i8").tobytes()],
                        "no_id": [none[a:b].tobytes()],
                        "n_docs": [b - a],
                        "n_tokens": [len(part)],
                        "ids": [lens[a:b].astype("<u8").tobytes() + _narrow(part)],
                        "counts": [total[used].astype("<i8").tobytes() + used.astype("<u4").tobytes()],
                    }
                )
                block, a = block + 1, b

    few = texts(docs)
    ordered = few.repartitionByRange(deals(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, BLOCKS)


def _counted(blocks: DataFrame) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = len(raw) // 12
                used = np.frombuffer(raw, "<u4", n, 8 * n)
                if n and used[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(used[-1]) + 1 - len(total), np.int64)])
                total[used] += np.frombuffer(raw, "<i8", n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return blocks.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2) -> str:
    """Tokenize and code all documents into a folder, and return it: a new one in the shared folder, if none is named."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or scratch(spark, "coded-ids")
    blocks = materialize(_tokenized(docs, path or T.default_path(), end_id), "ids")
    free_shuffles(spark)
    counts = {r["id"]: r["n"] for r in _counted(blocks).collect()}  # as many rows as the vocabulary has at most
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, n in counts.items():
        dense[k] = n
    lengths = code_lengths(dense)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used].astype(np.int32))})).coalesce(1).write.mode("overwrite").parquet(f"{folder}/code")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = row.pop("ids")
                lens = np.frombuffer(raw, "<u8", row["n_docs"]).astype(np.int64)
                data = encode_block(_ids_of(raw, row["n_docs"], row["n_tokens"]), lens, lengths, codes)
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k in ("shard", "block") else None) for k, v in row.items()} | {"coded": [data]})

    blocks.drop("counts").mapInArrow(run, CODED).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/blocks")
    discard(blocks)
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the coded files: where its ids begin, how many, and their crc32."""
    bounded_batches(spark)
    code = spark.read.parquet(f"{folder}/code").collect()  # as many rows as the vocabulary has at most
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    coded = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    sizes = coded.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("shard")) - F.col("all"))
    places = sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("start"))
    table = decode_table(lengths)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, lens = decode_block(row["coded"], table)
                ids, ends = ids.astype("<u4"), np.cumsum(lens)
                keys = np.frombuffer(row["doc_ids"], "<i8")
                none = np.frombuffer(row["no_id"], bool)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=none), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return coded.join(places, ["shard", "block"]).select("coded", "doc_ids", "no_id", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
