"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit where over half of its shingles' hashes have it.
Distinct fingerprints meet in groups that agree in two of four 16-bit blocks, as
any two within two differing bits do. In a group the fingerprints are stored as
vertical bit planes, 64 to a word; carry-save counters update 64 distances with a
few bitwise operations, and a word is abandoned once all its distances exceed the
radius. Each group gives at most one link per member, enough for components.

A group over HOT is split again by a third of its remaining bits, and once more:
two fingerprints in the radius agree in one of three parts, so no link is lost,
and a group of the last level can't hold more than 2**15 fingerprints.

Cases: null or empty text: fingerprint zero, linked like any other; null keys get
the class of their fingerprint but are no class's id (a class of null keys only
has a null id); repeated rows are returned each; empty table: no rows; other
columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import bulks, column, deals, discard, materialize, bounded_batches, texts
from motionloom.llm.graph import components, forest

RADIUS, HOT = 2, 4096
U = np.uint64
FULL = (1 << 64) - 1


def _masks() -> list[list[int]]:
    """Masks of the bits that a group agrees in, for each level; mask 3i+j of a level refines mask i of the one before."""
    blocks = [((1 << 16) - 1) << (16 * i) for i in range(4)]
    levels = [[a | b for a, b in combinations(blocks, 2)]]
    for _ in range(2):
        finer = []
        for m in levels[-1]:
            rest = [i for i in range(64) if not m >> i & 1]
            for j in range(3):
                finer.append(m | sum(1 << i for i in rest[j * len(rest) // 3 : (j + 1) * len(rest) // 3]))
        levels.append(finer)
    return levels


MASKS = _masks()


def fingerprints_of(texts: pa.Array, words: int = 3) -> np.ndarray:
    """Fingerprints of whole texts (large_string, no nulls)."""
    import xxhash

    texts = texts.cast(pa.large_string())
    n = len(texts)
    out = np.zeros(n, U)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return out
    b = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi].copy()
    offsets = offsets - lo
    b[(b >= 65) & (b <= 90)] += 32
    space = (b == 32) | ((b >= 9) & (b <= 13))
    b[space] = 32
    opens = np.zeros(len(b) + 1, bool)
    opens[offsets] = True
    after_word = np.concatenate([[False], ~space[:-1]]) & ~opens[:-1]
    keep = ~space | after_word  # one space after each word
    starts = np.flatnonzero(~space & ~after_word)
    ends = np.flatnonzero(~space & np.concatenate([space[1:] | opens[1:-1], [True]])) + 1
    place = np.concatenate([[0], np.cumsum(keep)])
    data = b[keep].tobytes()
    first = np.searchsorted(starts, offsets)
    starts, ends = place[starts], place[ends]
    hashed = xxhash.xxh64_intdigest
    for d in range(n):
        a, z = int(first[d]), int(first[d + 1])
        if a == z:
            continue
        if z - a < words:
            s, e = starts[a : a + 1], ends[z - 1 : z]
        else:
            s, e = starts[a : z - words + 1], ends[a + words - 1 : z]
        h = np.fromiter([hashed(data[i:j], 42) for i, j in zip(s.tolist(), e.tolist(), strict=True)], U, len(s))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > len(h), bitorder="little").view(U)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long of the same bits."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for table in bulks(batches):
            fp = fingerprints_of(column(table, "text"), words)
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one group whose fingerprints differ in at most `radius` bits.

    Groups lie one after another; ends[i] is the end of i's group.
    """
    n = len(fp)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.packbits(bits, axis=0, bitorder="little").T.copy().view(U)
    me = np.flatnonzero(ends - np.arange(n) > 1)
    count = ((ends[me] - 1) >> 6) - ((me + 1) >> 6) + 1
    left, right, digits = [], [], (radius + 1).bit_length()
    slab = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(me):
        z = max(a + 1, int(np.searchsorted(slab, slab[a] + (1 << 19), "right")) - 1)
        q = np.repeat(me[a:z], count[a:z])
        w = np.arange(len(q)) - np.repeat(slab[a:z] - slab[a], count[a:z]) + ((q + 1) >> 6)
        lo, hi = np.maximum(q + 1 - 64 * w, 0).astype(U), np.minimum(ends[q] - 64 * w, 64).astype(U)
        ones = U(FULL)
        over = ~((ones << lo) & (ones >> (U(64) - hi)))
        counter = [np.zeros(len(q), U) for _ in range(digits)]
        for b in range(64):
            x = planes[b][w] ^ (U(0) - ((fp[q] >> U(b)) & U(1)))
            reached = ones
            for d in range(digits):
                carry = counter[d] & x
                counter[d] = counter[d] ^ x
                x = carry
                reached = reached & (counter[d] if (radius + 1) >> d & 1 else ~counter[d])
            over = over | reached
            if b % 8 == 7:
                live = over != ones
                if not live.all():
                    q, w, over, counter = q[live], w[live], over[live], [c[live] for c in counter]
                    if not len(q):
                        break
        if len(q):
            lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            left.append(q[row])
            right.append(64 * w[row] + lane)
        a = z
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _linked(batches):
    """Links of groups, from rows sorted by group; the last group of a batch waits for the next."""
    held = None

    def found(table):
        m, key, fp = (np.concatenate([np.zeros(0, np.int64), column(table, c).to_numpy()]) for c in ("m", "key", "fp"))
        new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(new, len(m)))
        many = np.repeat(size > 1, size)
        if many.any():
            size = size[size > 1]
            kept = fp[many]
            i, j = close_pairs(kept.view(U), np.repeat(np.cumsum(size), size))
            label = forest(i, j, len(kept))
            linked = np.flatnonzero(label != np.arange(len(kept)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(kept[linked]), pa.array(kept[label[linked]])], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not len(table):
            continue
        m, key = column(table, "m").to_numpy(), column(table, "key").to_numpy()
        last = np.flatnonzero((m != m[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = table.slice(cut)
        if cut:
            yield from found(table.slice(0, cut).combine_chunks())
    if held is not None and len(held):
        yield from found(held.combine_chunks())


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of `distinct` (fp) that hold together all within the radius."""
    spark = distinct.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(MASKS[0])))).alias("g")).select("fp", "g.m", "g.key")
    out = None
    for level in range(3):
        hot = None
        if level < 2:
            hot = materialize(keys.groupBy("m", "key").count().where(F.col("count") > HOT).select("m", "key"), "hot")
            if hot.isEmpty():
                discard(hot)
                hot = None
        now = keys if hot is None else keys.join(hot, ["m", "key"], "left_anti")
        found = now.select("m", "key", "fp").repartition(deals(spark), "m", "key").sortWithinPartitions("m", "key", "fp").mapInArrow(_linked, "a long, b long")
        out = found if out is None else out.union(found)
        if hot is None:
            break
        finer = F.array(*(F.lit(signed(m)) for m in MASKS[level + 1]))
        child = lambda j, finer=finer: F.struct((F.col("m") * 3 + j).alias("m"), F.col("fp").bitwiseAND(F.element_at(finer, (F.col("m") * 3 + j + 1).cast("int"))).alias("key"))
        keys = keys.join(hot, ["m", "key"]).select("fp", F.explode(F.array(*(child(j) for j in range(3)))).alias("g")).select("fp", "g.m", "g.key")
    return out


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    prints = materialize(fingerprints(docs, words), "simhash")
    bounded_batches(docs.sparkSession)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "roots")
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classed = rooted.join(classes, "root").select("fp", "component_id")
    return prints.join(classed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
