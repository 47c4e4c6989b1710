"""Vector bin packing of examples into training sequences.

An example has a vector of demands (tokens, segments, loss-bearing tokens) and a
sequence a vector of limits. The dot-product heuristic puts into the open
sequence the fitting example whose demands, scaled by the limits, have the
largest dot product with what the sequence still has free.

Of plain documents, which may be cut, tokens and segments are limited; each id but a
segment's first bears loss, so the limit on loss binds only if it is set below the
sequence's size. Conversations are whole examples: a turn is a segment, and the
assistant's tokens bear loss.

Each task packs the rows it reads, so nothing is shuffled; a pool of POOL
examples bounds its memory. Sequence ids hold the partition in the upper bits,
so they are unique and the same when a lost task runs again.

Cases: null text is an empty document (one piece, its end id); empty table: no
rows; repeated rows are packed each; null keys stay null; other columns are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm import tokens as T
from motionloom.llm.common import bulks, column, bounded_batches, texts

POOL, SEGMENTS = 1024, 6
#: Limits of a sequence of instruction data: tokens, turns, loss-bearing tokens.
INSTRUCTION_LIMITS = (1024, 16, 768)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class DotPool:
    """Examples waiting for a place, with their demand vectors."""

    def __init__(self, limits: tuple[int, ...], room: int = POOL):
        self.limits = np.asarray(limits, np.float64)
        # a row for each limit, and the demands as parts of the limits
        self.demand = np.full((len(limits), 2 * room), np.inf)
        self.scaled = np.zeros((len(limits), 2 * room))
        self.what: list = [None] * (2 * room)
        self.free = list(range(2 * room))[::-1]

    def __len__(self) -> int:
        return len(self.what) - len(self.free)

    def add(self, demand: tuple[int, ...], what) -> None:
        if not self.free:
            n = len(self.what)
            self.demand = np.hstack([self.demand, np.full_like(self.demand, np.inf)])
            self.scaled = np.hstack([self.scaled, np.zeros_like(self.scaled)])
            self.what += [None] * n
            self.free = list(range(n, 2 * n))[::-1]
        k = self.free.pop()
        self.demand[:, k] = demand
        self.scaled[:, k] = demand / self.limits
        self.what[k] = what

    def best(self, left: np.ndarray) -> int | None:
        """Index of the fitting example with the largest dot product, the first of equals."""
        fits = self.demand[0] <= left[0]
        for own, most in zip(self.demand[1:], left[1:], strict=True):
            fits &= own <= most
        fits = fits.nonzero()[0]
        if not len(fits):
            return None
        value = sum(own[fits] * part for own, part in zip(self.scaled, (left / self.limits).tolist(), strict=True))
        return int(fits[value.argmax()])

    def largest(self) -> int | None:
        """The example with the most tokens of those that hold any."""
        t = np.where(np.isfinite(self.demand[0]), self.demand[0], -1)
        k = int(np.argmax(t))
        return k if t[k] >= 0 else None

    def take(self, k: int):
        what, demand = self.what[k], self.demand[:, k].copy()
        self.what[k] = None
        self.demand[:, k] = np.inf
        self.free.append(k)
        return demand, what


def pack_cut(docs, size: int, segments: int, emit, loss: int | None = None) -> None:
    """Pack (key, ids) examples, which may be cut anywhere, into sequences of `size` tokens and `segments` pieces.

    Whole runs of `size` ids fill sequences of their own; the rests wait in the
    pool. An open sequence takes fitting rests first, and then the head of the
    largest rest to its last free place. What is left at the end is laid out in
    sequences whose lengths are powers of two, which need no padding.
    emit(key, start, ids, total, sequence, offset) gets the pieces.
    """
    loss = size if loss is None else loss
    pool, sequence = DotPool((size, segments, loss)), 0
    run = min(size, loss + 1)  # ids of one document that fill a sequence

    def fill() -> None:
        nonlocal sequence
        left, at = pool.limits.copy(), 0
        while left[0] > 0 and left[1] > 0 and len(pool):
            k = pool.best(left)
            if k is None:
                k = pool.largest()
                _, (key, start, ids, total) = pool.take(k)
                n = int(min(left[0], left[2] + 1))
                if len(ids) > n:
                    pool.add((len(ids) - n, 1, len(ids) - n - 1), (key, start + n, ids[n:], total))
                    ids = ids[:n]
            else:
                _, (key, start, ids, total) = pool.take(k)
            emit(key, start, ids, total, sequence, at)
            at += len(ids)
            left -= (len(ids), 1, len(ids) - 1)
        sequence += 1

    for key, ids in docs:
        total, whole = len(ids), len(ids) - len(ids) % size if run == size else 0
        for start in range(0, whole, size):
            emit(key, start, ids[start : start + size], total, sequence, 0)
            sequence += 1
        for start in range(whole, total, run):
            part = ids[start : start + run]
            pool.add((len(part), 1, len(part) - 1), (key, start, part, total))
        while len(pool) > POOL:
            fill()
        yield
    while sum(len(w[2]) for w in pool.what if w) >= size:
        fill()
    rest = [pool.take(k)[1] for k in range(len(pool.what)) if pool.what[k]]
    sequence -= 1
    for a in range(0, len(rest), segments):
        own = rest[a : a + segments]
        length = sum(len(r[2]) for r in own)
        room, at, bits = 0, 0, [1 << b for b in range(length.bit_length())[::-1] if length >> b & 1]
        for key, start, ids, total in own:
            while len(ids):
                if at == room:
                    room, at, sequence = bits.pop(0), 0, sequence + 1
                n = min(len(ids), room - at)
                emit(key, start, ids[:n], total, sequence, at)
                start, ids, at = start + n, ids[n:], at + n


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, segments: int = SEGMENTS, loss: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document; pieces of a sequence_id lie gapless from offset 0."""
    path = path or T.default_path()
    bounded_batches(docs.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        encoder, rows = T.encoder(path), []

        def emit(key, start, ids, total, sequence, offset):
            rows.append((key, start, len(ids), zlib.crc32(ids), total, (part << 32) | sequence, offset))

        def examples():
            for table in bulks(batches):
                ids, lens = encoder.encode(column(table, "text"))
                ids, ends = ids.astype("<u4", copy=False), np.cumsum(lens)
                for k, a, b in zip(column(table, "doc_id").to_pylist(), (ends - lens).tolist(), ends.tolist(), strict=True):
                    yield k, np.append(ids[a:b], np.uint32(end_id))

        names = [x.split()[0] for x in PIECES.split(", ")]

        def flushed():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for _ in pack_cut(examples(), size, segments, emit, loss):
            if len(rows) >= 20_000:
                yield flushed()
        if rows:
            yield flushed()

    return texts(docs, key, text).mapInArrow(run, PIECES)


def pack_vectors(examples: DataFrame, key: str, demands: list[str], limits: list[int]) -> DataFrame:
    """Pack whole examples under simultaneous limits; for instruction data these are
    tokens, segments and loss-bearing tokens. An example over a limit by itself is
    kept, alone in its sequence (oversize true); null and negative demands count as 0."""
    bounded_batches(examples.sparkSession)
    n_dim = len(demands)

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        pool, sequence, out = DotPool(tuple(limits)), 0, []

        def fill():
            nonlocal sequence
            left, place = pool.limits.copy(), 0
            while (k := pool.best(left)) is not None:
                demand, what = pool.take(k)
                out.append((what, (part << 32) | sequence, place, False))
                left -= demand
                place += 1
            sequence += 1

        for batch in batches:
            cols = [batch.column(i).fill_null(0).to_pylist() for i in range(1, n_dim + 1)]
            for k, *demand in zip(batch.column(0).to_pylist(), *cols, strict=True):
                if any(d > m for d, m in zip(demand, limits, strict=True)):
                    out.append((k, (part << 32) | sequence, 0, True))
                    sequence += 1
                else:
                    pool.add(tuple(demand), k)
            while len(pool) > POOL:
                fill()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["example", "sequence_id", "place", "oversize"])
                out.clear()
        while len(pool):
            fill()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["example", "sequence_id", "place", "oversize"])

    cols = [examples[key].cast("long").alias("example"), *(F.greatest(examples[d].cast("long"), F.lit(0)).alias(f"d{i}") for i, d in enumerate(demands))]
    return examples.select(*cols).mapInArrow(run, "example long, sequence_id long, place long, oversize boolean")


def conversation_demands(turns: DataFrame, path: str | None = None, end_id: int = 0, learned: str = "assistant") -> DataFrame:
    """(conv_id, tokens, segments, loss_tokens) of conversations, from rows of turns.

    Each turn ends with one end id; the turns of the `learned` role bear loss. Null
    text is an empty turn; turns without a conversation's id are one conversation.
    """
    path = path or T.default_path()
    bounded_batches(turns.sparkSession)

    def run(batches):
        encoder = T.encoder(path)
        for table in bulks(batches):
            _, lens = encoder.encode(column(table, "text"))
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(lens + 1, pa.int64()), column(table, "role")], ["conv_id", "tokens", "role"])

    few = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role"))
    each = few.mapInArrow(run, "conv_id long, tokens long, role string")
    return each.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum(F.when(F.col("role") == learned, F.col("tokens")).otherwise(0)).alias("loss_tokens"))


def pack_conversations(turns: DataFrame, path: str | None = None, limits: tuple[int, ...] = INSTRUCTION_LIMITS) -> DataFrame:
    """example (conv_id), sequence_id, place, oversize: whole conversations under limits on tokens, turns and loss-bearing tokens."""
    return pack_vectors(conversation_demands(turns, path), "conv_id", ["tokens", "segments", "loss_tokens"], list(limits))
