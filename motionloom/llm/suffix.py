"""Exact repeated-substring removal with longest-previous-factor arrays.

Every byte covered by a LEAST-byte string that also starts in a document with a
smaller key is removed; the first document that holds a string keeps it.

Any LEAST-byte window holds the same anchor wherever it stands: the GRAM-byte
string with the least hash in it, the leftmost of equals. Consecutive windows with
one anchor form a stretch. Each task puts the rows it reads into chunks of whole
documents, so texts are not shuffled to be chunked:

1. each chunk sends the hashes of its anchors, each once, to the buckets of the
   hashes; a bucket answers which of them stand in more than one document, and
   which have more than HOT different surroundings;
2. the windows of a hot anchor are told apart one by one: each becomes a stretch of
   its own whose anchor is the window itself, and step 1 is done for these. So a
   frequent string with ever different surroundings is spread over all buckets;
3. each chunk sends its different stretches around repeated anchors, with the first
   document of each, to the buckets. There suffixes are sorted to LEAST bytes, and
   for each the previous and next smaller document in suffix order give its
   longest previous factor; a bucket answers which windows have one of LEAST bytes;
4. each chunk marks and cuts the bytes of those windows, and gives out its rows.

A string that stands in very many documents is sent once by a chunk. There are as
many buckets as chunks, and both are of at least CHUNK bytes of text; beyond 15 GB
they grow with the square root of the input, so that a chunk's message to a bucket
stays worth its overhead. The reader of a bucket holds one message of each chunk.
Stretches of a bucket that are equal are told by their bytes; the arrays are made
of those that differ.

Cases: null or empty text: no bytes, nothing removed; a null key is neither earlier
nor later than any other, so such rows stay whole and remove nothing; rows of one
key remove nothing from each other, in whatever order they come; empty table: no
rows; other columns, of any names, are kept by `clean` and not read by `digests`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from motionloom.llm.common import bounded_batches, discard, free_shuffles, materialize, trim

LEAST, GRAM, CHUNK, SLAB = 50, 20, 4 << 20, 1 << 17
#: Different surroundings from which on an anchor's windows are told apart; what they are counted as in a chunk, by its two bits.
HOT, COUNTED_AS = 4096, np.array([1, 2, 16, 256])
#: Bytes of text for each byte of hashes, and the least useful size of a message: chunks grow so that messages do.
MESSAGE = 1067
NO_KEY = np.iinfo(np.int64).max
U = np.uint64
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    at, out = 8 * (1 + len(kinds)), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each `gram` bytes."""
    powers, level, width = {1: b.astype(U) + U(1)}, 1, len(b)
    while 2 * level <= gram:
        h = powers[level]
        powers[2 * level] = h[:-level] * U(pow(BASE, level, 1 << 64)) + h[level:]
        level *= 2
    out, at = None, 0
    n = width - gram + 1
    for level in sorted(powers, reverse=True):
        if gram & level:
            part = powers[level][at : at + n]
            out = part.copy() if out is None else out * U(pow(BASE, level, 1 << 64)) + part
            at += level
    out ^= out >> U(32)
    out *= U(MIX)
    out ^= out >> U(29)
    out *= U(BASE)
    out ^= out >> U(32)
    return out


def _stretches_of(b: np.ndarray, bounds: np.ndarray, least: int, gram: int):
    """Stretches of one slab: first window, number of windows, anchor hash, document."""
    n = len(b) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U), np.zeros(0, np.int64))
    h = gram_hashes(b, gram)
    shift = U(max(1, int(len(b)).bit_length()))
    m = ((h >> shift) << shift) | np.arange(len(h), dtype=U)  # the hash's upper bits, and the place below them
    want, level = least - gram + 1, 1
    while 2 * level <= want:
        m = np.minimum(m[:-level], m[level:])
        level *= 2
    if level < want:
        m = np.minimum(m[: n], m[want - level : want - level + n])
    m = m[:n]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + least <= bounds[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    place = (m[first] & ((U(1) << shift) - U(1))).astype(np.int64)
    return first, stop - first, h[place], doc[first]


def stretches(b: np.ndarray, bounds: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """As above over a whole chunk, slab by slab of whole documents."""
    out, d = [], 0
    while d < len(bounds) - 1:
        e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + SLAB, "right")) - 1)
        first, count, h, doc = _stretches_of(b[bounds[d] : bounds[e]], bounds[d : e + 1] - bounds[d], least, gram)
        out.append((first + bounds[d], count, h, doc + d))
        d = e
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number; zeros follow the end."""
    w = np.concatenate([b, np.zeros(7, np.uint8)]).astype(U)
    for level in (1, 2, 4):
        w = (w[:-level] << U(8 * level)) | w[level:]
    return w


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `depth` bytes, equals by place, and the
    length (at most depth) each has in common with the one before it in that order."""
    words, n = words_at(text), len(starts)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # number of the group of suffixes not told apart yet, by place in the order
    tied = np.arange(n)
    for off in [*range(0, depth - 8 + 1, 8), *([depth - 8] if depth % 8 else [])]:
        key = words[starts[order[tied]] + off]
        sub = np.lexsort((key, group[tied]))
        order[tied] = order[tied[sub]]
        key = key[sub]
        same_group = np.concatenate([[False], group[tied[1:]] == group[tied[:-1]]])
        differ = np.concatenate([[True], key[1:] != key[:-1]])
        x = np.concatenate([[U(0)], key[1:] ^ key[:-1]])
        split = same_group & differ
        equal = 7 - (np.frexp(x[split].astype(np.float64))[1] - 1) // 8
        # rounding to a double may carry a value up to the next power of two: count once more
        equal += (x[split] < (U(1) << (U(8) * (7 - equal).astype(U)))).astype(np.int64)
        lcp[tied[split]] = off + equal
        inside = same_group & ~differ
        lcp[tied[inside]] = off + 8
        fresh = np.ones(n, bool)
        fresh[tied[inside]] = False
        group = np.cumsum(fresh) - 1
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            break
    return order, np.minimum(lcp, depth)


def previous_factors(rank: np.ndarray, lcp: np.ndarray, least: int = 0) -> np.ndarray:
    """Longest previous factor of each suffix, from ranks (documents, or places) in suffix order.

    It is the larger of what a suffix has in common with the previous and with the
    next one in that order whose rank is smaller. Both are found for all suffixes
    side by side: a candidate that isn't smaller passes on its own candidate. Common
    lengths under `least` end the search and count as 0.
    """
    n = len(rank)
    best = np.zeros(n, np.int64)
    for side in (1, -1):
        r, common = (rank, lcp) if side == 1 else (rank[::-1], np.concatenate([[0], lcp[1:][::-1]]))
        to, length = np.arange(n) - 1, common.copy()
        length[:1] = 0
        open_ = np.flatnonzero(length >= max(least, 1))
        dead = np.ones(n, bool)
        dead[open_] = False
        length[dead], to[dead] = 0, -1
        while len(open_):
            bigger = r[to[open_]] >= r[open_]
            open_ = open_[bigger]
            if not len(open_):
                break
            via = to[open_]
            length[open_] = np.minimum(length[open_], length[via])
            to[open_] = to[via]
            gone = (to[open_] < 0) | (length[open_] < max(least, 1))
            length[open_[gone]], to[open_[gone]] = 0, -1
            open_ = open_[~gone]
        best = np.maximum(best, length if side == 1 else length[::-1])
    return best


def repeated_windows(stretch: list[bytes], first_doc: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each different stretch, which of its windows stand in one with a smaller document."""
    by_doc = np.argsort(first_doc, kind="stable")
    sizes = np.array([len(stretch[i]) for i in by_doc], np.int64)
    text = np.frombuffer(b"".join(stretch[i] for i in by_doc), np.uint8)
    windows = sizes - least + 1
    begin, ends = np.cumsum(sizes) - sizes, np.cumsum(windows)
    starts = np.repeat(begin - (ends - windows), windows) + np.arange(int(windows.sum()))
    order, lcp = suffix_order(text, starts, least)
    found = np.zeros(len(starts), bool)
    found[order] = previous_factors(np.repeat(first_doc[by_doc], windows)[order], lcp, least) >= least
    out: list = [None] * len(stretch)
    for k, i in enumerate(by_doc.tolist()):
        out[i] = found[ends[k] - windows[k] : ends[k]]
    return out


class Chunk:
    """Rows of a chunk, in ascending order of keys, and their stretches."""

    def __init__(self, blob: bytes, least: int, gram: int):
        self.keys, self.none, lens, self.bytes = unpack(blob, "<i8", "?", "<i8", "u1")
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        self.least = least
        self.first, self.count, self.anchor, self.doc = stretches(self.bytes, self.bounds, least, gram)
        keyed = ~self.none[self.doc] if len(self.doc) else np.zeros(0, bool)
        self._keep(keyed)
        self.fine = np.zeros(len(self.first), bool)

    def _keep(self, which: np.ndarray) -> None:
        self.first, self.count, self.anchor, self.doc = (x[which] for x in (self.first, self.count, self.anchor, self.doc))

    def refine(self, hot: np.ndarray) -> None:
        """Make each window of a stretch around a hot anchor (sorted hashes) a stretch by itself."""
        if not len(hot) or not len(self.anchor):
            return
        split = _among(self.anchor, hot)
        if not split.any():
            return
        n = np.where(split, self.count, 1)
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        fine = np.repeat(split, n)
        first, doc, anchor = np.repeat(self.first, n) + inside, np.repeat(self.doc, n), np.repeat(self.anchor, n)
        anchor[fine] = _window_hashes(self.bytes, first[fine], self.least)
        self.first, self.count, self.anchor, self.doc, self.fine = first, np.where(fine, 1, np.repeat(self.count, n)), anchor, doc, fine

    def _surroundings(self) -> np.ndarray:
        """A hash that mostly differs where stretches around one anchor do."""
        ends = self.first + self.count + self.least - 1
        n = len(self.bytes)
        out = self.count.astype(U)
        for k in range(0, 24, 3):
            out = out * U(BASE) + self.bytes[np.minimum(self.first + k, n - 1)] + U(257) * self.bytes[ends - 1 - k]
        return out

    def anchors(self, buckets: int, fine: bool = False):
        """(bucket, hashes, whether in two documents here, class of the number of surroundings) of each bucket that gets any."""
        which = np.flatnonzero(self.fine == fine)
        anchor, doc, around = self.anchor[which], self.doc[which], self._surroundings()[which]
        order = np.lexsort((around, anchor))
        h, around = anchor[order], around[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        several, size = np.zeros(len(at), bool), np.zeros(len(at), np.uint8)
        if len(at):
            key = self.keys[doc[order]]
            several = np.maximum.reduceat(key, at) != np.minimum.reduceat(key, at)
            differ = np.add.reduceat((new | np.concatenate([[True], around[1:] != around[:-1]])).astype(np.int64), at)
            size = (np.searchsorted(COUNTED_AS, differ, "right") - 1).astype(np.uint8)
        h = h[at]
        bucket = (h % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.unique(bucket).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            yield k, h[own], several[own], size[own]

    def shared(self, repeated: np.ndarray, buckets: int):
        """Stretches at the given anchors (sorted hashes): by bucket, the different ones, and where each stands."""
        mine = np.flatnonzero(_among(self.anchor, repeated)) if len(repeated) else np.zeros(0, np.int64)
        data, tail = self.bytes.tobytes(), self.least - 1
        number: dict[tuple[int, bytes], int] = {}
        which = np.zeros(len(mine), np.int64)
        bucket = (self.anchor[mine] % U(buckets)).tolist()
        for j, (k, a, n) in enumerate(zip(bucket, self.first[mine].tolist(), self.count[mine].tolist(), strict=True)):
            which[j] = number.setdefault((k, data[a : a + n + tail]), len(number))
        first = np.full(len(number), len(mine), np.int64)
        np.minimum.at(first, which, np.arange(len(mine)))
        return mine, which, first, list(number)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is one of the sorted values."""
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _window_hashes(b: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the windows of `least` bytes at these places, some at a time."""
    out = np.empty(len(starts), U)
    for a in range(0, len(starts), 1 << 16):
        h = np.zeros(len(starts[a : a + (1 << 16)]), U)
        for k in range(least):
            h = h * U(BASE) + (b[starts[a : a + (1 << 16)] + k].astype(U) + U(1))
        h ^= h >> U(32)
        h *= U(MIX)
        out[a : a + (1 << 16)] = h ^ (h >> U(29))
    return out


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, blob, rest): whole documents, about chunk_bytes in each chunk; rest holds their other columns."""

    def put(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys, text = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        # ascending keys; rows without a key are last
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, text[i]))
        key = np.array([NO_KEY if keys[i] is None else keys[i] for i in order], np.int64)
        none = np.array([keys[i] is None for i in order])
        lens = np.array([len(text[i]) for i in order], "<i8")
        blob = pack(key, none, lens, np.frombuffer(b"".join(text[i] for i in order), np.uint8))
        rest = pa.Table.from_arrays([rows.column("rest").take(pa.array(order, pa.int64()))], ["rest"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "blob": [blob], "rest": [zstandard.compress(sink.getvalue().to_pybytes(), 1)]})

    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = np.array(pa.compute.binary_length(batch.column("text")).to_pylist(), np.int64)
            a = 0
            while a < batch.num_rows:
                e = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), chunk_bytes - size, "left")) + 1)
                held.append(batch.slice(a, e - a))
                size, a = size + int(sizes[a:e].sum()), e
                if size >= chunk_bytes:
                    yield put(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
                    trim()
        if held:
            yield put(chunk, held)

    return docs.mapInArrow(run, "chunk long, blob binary, rest binary")


def _send_anchors(own: pa.Table, hot: pa.Table | None, least: int, gram: int, buckets: int):
    for chunk, blob in zip(own.column("chunk").to_pylist(), own.column("blob").to_pylist(), strict=True):
        c = Chunk(blob, least, gram)
        if hot is not None:
            c.refine(_answered(c, hot, buckets, "hot"))
        for k, h, several, size in c.anchors(buckets, hot is not None):
            h = h // U(buckets)
            sent = h.astype("<u4").tobytes() + (h >> U(32)).astype("<u4").tobytes() + np.packbits(several).tobytes() + np.packbits(size & 1).tobytes() + np.packbits(size >> 1).tobytes()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "n": [len(h)], "sent": [sent]})
        del c
        trim()


ANCHORS = "bucket long, chunk long, n long, sent binary"
ANSWERS = "chunk long, bucket long, answer binary, hot binary"


def _answer_anchors(table: pa.Table, limit: int) -> pa.Table:
    rows = table.to_pylist()
    hashes, several, size = [], [], []
    for r in rows:
        n, raw = r["n"], r["sent"]
        m = -(-n // 8)
        bits = [np.unpackbits(np.frombuffer(raw, np.uint8, m, 8 * n + j * m))[:n] for j in range(3)]
        hashes.append(np.frombuffer(raw, "<u4", n).astype(U) | (np.frombuffer(raw, "<u4", n, 4 * n).astype(U) << U(32)))
        several.append(bits[0].astype(bool))
        size.append(COUNTED_AS[bits[1] + 2 * bits[2]])
    every = np.concatenate(hashes)
    _, back, count = np.unique(every, return_inverse=True, return_counts=True)
    marked = np.zeros(len(count), bool)
    marked[back[np.concatenate(several)]] = True
    shared = (marked | (count > 1))[back]
    hot = (np.bincount(back, np.concatenate(size)) > limit)[back] & shared
    at, out, hots = 0, [], []
    for h in hashes:
        out.append(np.packbits(shared[at : at + len(h)]).tobytes())
        own = hot[at : at + len(h)]
        hots.append(np.packbits(own).tobytes() if own.any() else None)
        at += len(h)
    told = pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "answer": pa.array(out, pa.binary()), "hot": pa.array(hots, pa.binary())})
    del rows, hashes, several, size, every, back, count, marked, shared, hot
    trim()
    return told


def _answered(chunk: Chunk, answers: pa.Table, buckets: int, column: str, fine: bool = False) -> np.ndarray:
    """The chunk's anchors that the buckets say yes to, sorted."""
    got = {r["bucket"]: np.unpackbits(np.frombuffer(r[column], np.uint8)) for r in answers.select(["bucket", column]).to_pylist() if r[column] is not None}
    found = [h[got[k][: len(h)].astype(bool)] for k, h, *_ in chunk.anchors(buckets, fine) if k in got] if got else []
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U)


def _ready(blob: bytes, answers: pa.Table, least: int, gram: int, buckets: int) -> tuple[Chunk, np.ndarray]:
    """The chunk with its hot anchors told apart, and the anchors that repeat."""
    chunk = Chunk(blob, least, gram)
    kind = answers.column("kind").to_numpy() if len(answers) else np.zeros(0, np.int64)
    coarse, fine = (answers.filter(pa.array(kind == k)) for k in (0, 1))
    repeated, hot = (_answered(chunk, coarse, buckets, c) for c in ("answer", "hot"))
    if len(hot):
        chunk.refine(hot)
        repeated = np.sort(np.concatenate([repeated[~_among(repeated, hot)], _answered(chunk, fine, buckets, "answer", True)]))
    return chunk, repeated


def _send_stretches(chunks: pa.Table, answers: pa.Table, least: int, gram: int, buckets: int) -> pa.Table:
    out: list[tuple] = []
    for row in chunks.to_pylist():
        chunk, repeated = _ready(row["blob"], answers, least, gram, buckets)
        mine, _, first, different = chunk.shared(repeated, buckets)
        docs = chunk.keys[chunk.doc[mine[first]]] if len(first) else np.zeros(0, np.int64)
        bucket = np.array([k for k, _ in different], np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.unique(bucket).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            parts = [different[i][1] for i in own.tolist()]
            sent = pack(docs[own], np.array([len(p) for p in parts], "<i4"), np.frombuffer(b"".join(parts), np.uint8))
            out.append((k, row["chunk"], sent))
        del chunk, mine, different, docs
        trim()
    return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "chunk": pa.array([r[1] for r in out], pa.int64()), "sent": pa.array([r[2] for r in out], pa.binary())})


def _answer_stretches(table: pa.Table, least: int) -> pa.Table:
    rows, number, first, sent = table.to_pylist(), {}, [], []
    for r in rows:
        docs, lens, raw = unpack(r["sent"], "<i8", "<i4", "u1")
        raw, at, own = raw.tobytes(), 0, []
        for d, n in zip(docs.tolist(), lens.tolist(), strict=True):
            k = number.setdefault(raw[at : at + n], len(number))
            at += n
            if k == len(first):
                first.append(d)
            elif d < first[k]:
                first[k] = d
            own.append(k)
        sent.append((docs.tolist(), own))
    found = repeated_windows(list(number), np.array(first, np.int64), least)
    del rows, number
    trim()
    chunks, buckets, out = table.column("chunk"), table.column("bucket"), []
    for docs, own in sent:
        bits = [found[k] if d == first[k] else np.ones(len(found[k]), bool) for d, k in zip(docs, own, strict=True)]
        out.append(zstandard.compress(np.packbits(np.concatenate(bits)).tobytes(), 1))
    return pa.table({"chunk": chunks, "bucket": buckets, "answer": pa.array(out, pa.binary())})


def _cut(chunks: pa.Table, answers: pa.Table, least: int, gram: int, buckets: int, give: Callable) -> list[pa.Table]:
    out = []
    kind = answers.column("kind").to_numpy() if len(answers) else np.zeros(0, np.int64)
    windows = answers.filter(pa.array(kind == 2))
    for row in chunks.to_pylist():
        chunk, repeated = _ready(row["blob"], answers, least, gram, buckets)
        mine, which, first, different = chunk.shared(repeated, buckets)
        cover = np.zeros(len(chunk.bytes) + 1, np.int32)
        if len(mine):
            bucket = np.array([k for k, _ in different], np.int64)
            sizes = np.array([len(p) for _, p in different], np.int64) - least + 1
            order = np.argsort(bucket, kind="stable")
            bits, got = [], {r["bucket"]: r["answer"] for r in windows.select(["bucket", "answer"]).to_pylist()}
            wanted = np.bincount(bucket, sizes, buckets).astype(np.int64)
            for k in np.unique(bucket).tolist():
                bits.append(np.unpackbits(np.frombuffer(zstandard.decompress(got[k]), np.uint8))[: wanted[k]])
            bits = np.concatenate(bits).astype(bool)
            base = np.zeros(len(different), np.int64)
            base[order] = np.cumsum(sizes[order]) - sizes[order]
            keys = chunk.keys[chunk.doc[mine]]
            later = keys > keys[first[which]]  # a smaller document of this chunk has the same stretch
            count = chunk.count[mine]
            ends = np.cumsum(count)
            inside = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
            flag = np.repeat(later, count) | bits[np.repeat(base[which], count) + inside]
            at = (np.repeat(chunk.first[mine], count) + inside)[flag]
            del inside, flag, bits
            # windows of one place: one at most
            cover[at] += 1
            cover[at + least] -= 1
            del at
        del mine, which, first, different
        trim()
        np.cumsum(cover, out=cover)
        out.append(give(chunk, cover[:-1] > 0, row.get("rest")))
        del chunk, cover
        trim()
    return out


def _digest(chunk: Chunk, gone: np.ndarray, _) -> pa.Table:
    rows = []
    for a, z in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True):
        g = gone[a:z]
        spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if z > a else 0
        rows.append((z - a, int(g.sum()), spans, hashlib.sha256(chunk.bytes[a:z][~g].tobytes()).hexdigest()))
    n_bytes, removed, spans, sha = zip(*rows, strict=True)
    return pa.table({"doc_id": pa.array(chunk.keys, mask=chunk.none), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _kept(chunk: Chunk, gone: np.ndarray, rest: bytes) -> pa.Table:
    """The rows with their remaining text; a character of which a part is removed goes whole.
    A row that had text and has none left goes."""
    other = pa.ipc.open_stream(zstandard.decompress(rest)).read_all().combine_chunks().column("rest").chunk(0)
    text = [chunk.bytes[a:z][~gone[a:z]].tobytes().decode("utf-8", "ignore") for a, z in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)]
    null, has = other.field(0).to_pylist(), np.diff(chunk.bounds) > 0
    stays = pa.array(~has | np.array([bool(t) for t in text]))
    cols = [other.field(i) for i in range(1, other.type.num_fields)]
    table = pa.table([pa.array([None if z else t for t, z in zip(text, null, strict=True)], pa.string()), *cols], [f"k{i}" for i in range(1 + len(cols))])
    return table.filter(stays)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(docs: DataFrame, key: str, text: str, rest: list, give: Callable, schema, empty: pa.Table, least: int, gram: int, chunk_bytes: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), F.struct(F.col(text).isNull().alias("null"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("rest"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = max(chunk_bytes, math.isqrt(total * MESSAGE) if chunk_bytes >= CHUNK else 0)
    buckets = max(1, -(-total // size))
    chunks = materialize(_chunked(own, size), "chunks")
    texts = chunks.select("chunk", "blob")
    sent = texts.mapInArrow(lambda batches: (r for b in batches for r in _send_anchors(b, None, least, gram, buckets)), ANCHORS)
    answer = lambda t: _answer_anchors(t, hot)
    anchors = materialize(sent.groupBy("bucket").applyInArrow(answer, ANSWERS).withColumn("kind", F.lit(0)), "anchors")
    free_shuffles(spark)
    told = [anchors]
    if not anchors.where("hot is not null").isEmpty():
        some = texts.join(anchors.where("hot is not null").select("chunk").distinct(), "chunk", "left_semi")
        split = some.groupBy("chunk").cogroup(anchors.where("hot is not null").groupBy("chunk")).applyInArrow(lambda a, b: pa.Table.from_batches(list(_send_anchors(a, b, least, gram, buckets)), pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("sent", pa.binary())])), ANCHORS)
        told.append(materialize(split.groupBy("bucket").applyInArrow(answer, ANSWERS).withColumn("hot", F.lit(None).cast("binary")).withColumn("kind", F.lit(1)), "anchors"))
        free_shuffles(spark)
    known = told[0] if len(told) == 1 else told[0].union(told[1])
    pieces = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(partial(_send_stretches, least=least, gram=gram, buckets=buckets), "bucket long, chunk long, sent binary")
    windows = materialize(pieces.groupBy("bucket").applyInArrow(lambda t: _answer_stretches(t, least), "chunk long, bucket long, answer binary"), "windows")
    free_shuffles(spark)
    answers = known.union(windows.select("chunk", "bucket", "answer", F.lit(None).cast("binary").alias("hot"), F.lit(2).alias("kind")))

    def last(own, got):
        out = _cut(own, got, least, gram, buckets, give)
        return pa.concat_tables(out) if out else empty

    return (chunks if give is _kept else texts).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(last, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the remaining bytes, for every row."""
    kinds = [(n, pa.string() if n == "kept_sha256" else pa.int64()) for n in (p.split()[0] for p in DIGEST.split(", "))]
    return _removed(docs, key, text, [], _digest, DIGEST, pa.schema(kinds).empty_table(), least, gram, chunk_bytes, hot)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """The rows of docs with the remaining text; rows that had text and have none left are dropped."""
    rest = [c for c in docs.columns if c != text]
    kinds = [docs.schema[text], *(docs.schema[c] for c in rest)]
    schema = StructType([StructField(f"k{i}", f.dataType if i else StringType()) for i, f in enumerate(kinds)])
    blank = docs.sparkSession.createDataFrame([], schema).toArrow()
    out = _removed(docs, key, text, rest, _kept, schema, blank, least, gram, chunk_bytes, hot)
    place = {c: i for i, c in enumerate([text, *rest])}
    return out.select(*(F.col(f"k{place[c]}").alias(c) for c in docs.columns))
