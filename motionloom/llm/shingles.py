"""Near-duplicates by SimHash, and by the Jaccard similarity of word shingles, checked exactly.

Texts whose op2 fingerprints (3-word shingles, repeats included) differ in RADIUS bits or
fewer are linked by op2's operator, simhash.links(). Texts of one Jaccard similarity may
lie further apart than block tables for that radius reach, so they are linked beside it:

Words are runs of bytes without ASCII whitespace, A-Z in lower case. A text is the
set of its WORDS-word shingles (a shorter text: one shingle). Texts of one set are
one node. Nodes meet in buckets of BANDS keys, each over ROWS minimum hashes: two of
similarity s share one with probability 1 - (1 - s**5)**26, which is 0.99997 at 0.8
and more above. In a bucket all
pairs are compared, shingle by shingle, by products of 0/1 matrices over the shingles
that two nodes have. A large bucket is dealt into parts of about PART nodes or
SHINGLES shingles, and each two parts are compared in a group of their own. Each
group gives at most one link per node, enough for components.

Both kinds of links make one graph of nodes: a fingerprint stands for its least node,
and the others that have it are linked to that.

Cases: null or empty texts are one class, fingerprint zero; null keys and repeated rows are rows like
any other; empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from motionloom.llm import simhash
from motionloom.llm.common import bulks, column, deals, discard, free_shuffles, materialize, bounded_batches, trim
from motionloom.llm.graph import components, forest
from motionloom.llm.words import POWERS, U, _mixed, flat, hashes, lowered, runs

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 26, 5
PART, SHINGLES, SLAB = 1024, 1 << 20, 4096
_RNG = np.random.Generator(np.random.PCG64(8))
TURN, TIMES = (_RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.int64).astype(U) for _ in range(2))
TIMES = TIMES << U(1) | U(1)


def shingles_of(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as sorted hashes, one text after another, and where each text begins and ends."""
    b, bounds = flat(texts)
    b = lowered(b)
    starts, ends = runs(~((b == 32) | ((b >= 9) & (b <= 13))), bounds)
    h = hashes(b, starts, ends)
    first = np.searchsorted(starts, bounds)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    left = first[1:][doc] - np.arange(len(h))  # words from here to the text's end
    whole = np.flatnonzero((left >= words) | ((n < words)[doc] & (left == n[doc])))
    sums = np.zeros(len(whole), U)
    for j in range(words):
        has = left[whole] > j
        sums[has] += h[whole[has] + j] * POWERS[j]
    sums, doc = _mixed(sums), doc[whole]
    order = np.lexsort((sums, doc))
    sums, doc = sums[order], doc[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (doc[1:] != doc[:-1])
    return sums[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _keys(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bucket keys (texts x BANDS) of texts that have shingles."""
    out = np.zeros((len(cuts) - 1, BANDS), U)
    for i in range(BANDS):
        key = np.full(len(cuts) - 1, i, U)
        for j in range(ROWS):
            key = _mixed(key * POWERS[8] + np.minimum.reduceat((h ^ TURN[i, j]) * TIMES[i, j], cuts[:-1]))
        out[:, i] = key
    return out


def prints(docs: DataFrame) -> DataFrame:
    """docs (with `text`), written, with a row number, its node, its fingerprint, its number of shingles and its bucket keys (none for empty texts)."""
    import xxhash

    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    schema = StructType([*rows.schema.fields]).add("node", LongType()).add("fp", LongType()).add("size", IntegerType()).add("keys", ArrayType(LongType()))
    names = schema.names

    def run(batches):
        for table in bulks(batches):
            text = column(table, "text").fill_null("")
            h, cuts = shingles_of(text)
            size = np.diff(cuts)
            some = size > 0
            node = [xxhash.xxh3_64_intdigest(h[a:z].tobytes()) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            keys = _keys(h, np.append(cuts[:-1][some], cuts[-1])).view(np.int64).ravel() if some.any() else np.zeros(0, np.int64)
            places = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            added = [pa.array(np.array(node, U).view(np.int64)), pa.array(simhash.fingerprints_of(text).view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(places), pa.array(keys))]
            yield pa.RecordBatch.from_arrays([*(column(table, c) for c in names[:-4]), *added], names)

    return materialize(rows.mapInArrow(run, schema), "shingles")


def _intersections(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of shingles that the sets of a group share, each pair's."""
    n = len(size)
    h, column_of, times = np.unique(h, return_inverse=True, return_counts=True)
    # shingles of one set only are in no intersection
    place = np.cumsum(times > 1) - 1
    kept = times[column_of] > 1
    at, row = place[column_of[kept]], np.repeat(np.arange(n), size)[kept]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, SLAB):
        s, e = np.searchsorted(at, [a, a + SLAB])
        has = np.zeros((n, min(SLAB, int(at[-1]) + 1 - a)), np.float32)
        has[row[s:e], at[s:e] - a] = 1
        both += has @ has.T
    return both


def _linked(batches):
    """Links of groups, from rows (key, part, node, text) sorted by group; the last group of a batch waits for the next."""
    held = None

    def found(table):
        key, part, node = (column(table, c).to_numpy() for c in ("key", "part", "node"))
        h, cuts = shingles_of(column(table, "text"))
        new = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])), len(key))
        left, right = [], []
        for a, z in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            size = np.diff(cuts[a : z + 1])
            both = _intersections(h[cuts[a] : cuts[z]], size)
            i, j = np.nonzero(np.triu(both >= SIMILAR * (size[:, None] + size[None] - both) - 1e-3, 1))
            label = forest(i, j, z - a)
            linked = np.flatnonzero(label != np.arange(z - a))
            left.append(node[a + linked])
            right.append(node[a + label[linked]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
        del h, cuts, left, right
        trim()

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not len(table):
            continue
        key, part = (table.column(c).to_numpy() for c in ("key", "part"))
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = table.slice(cut)
        if cut:
            yield from found(table.slice(0, cut).combine_chunks())
    if held is not None and len(held):
        yield from found(held.combine_chunks())


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of prints() that hold together all whose fingerprints are linked."""
    marked = materialize(rows.select("node", "fp").distinct(), "fingerprints")
    firsts = materialize(marked.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    bounded_batches(rows.sparkSession)
    near = simhash.links(firsts.select("fp"))
    for k in "ab":
        near = near.join(firsts.select(F.col("fp").alias(k), F.col("first").alias("node" + k)), k)
    equal = marked.join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = materialize(equal.union(near.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))).where("a <> b").distinct(), "links")
    discard(marked, firsts)
    return found


def links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of prints() that hold together all of SIMILAR at least."""
    spark = rows.sparkSession
    firsts = rows.where("size > 0").groupBy("node").agg(F.min("row").alias("row")).select("row")
    sets = rows.join(firsts, "row", "left_semi")
    members = materialize(sets.select("node", "size", F.explode("keys").alias("key")), "buckets")
    # buckets of the same nodes, as the copies of one text share many, are one
    marks = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"mark{i}") for i in range(2)]
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *marks).where("n > 1")
    shared = shared.groupBy("n", "total", "mark0", "mark1").agg(F.min("key").alias("key"))
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("total") / SHINGLES)).cast("int")
    groups = members.join(shared.select("key", parts.alias("parts")), "key")
    # a large bucket is dealt into parts, and each two parts are a group
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: (i != own) | (F.col("parts") == 1))
    part = F.transform(others, lambda i: F.least(i, own) * F.col("parts") + F.greatest(i, own))
    groups = materialize(groups.select("node", "key", F.explode(part).alias("part")), "groups")
    discard(members)
    texts = sets.select("node", F.coalesce("text", F.lit("")).alias("text"))
    laid = groups.join(texts, "node").select("key", "part", "node", "text").repartition(deals(spark), "key", "part").sortWithinPartitions("key", "part")
    bounded_batches(spark)
    found = materialize(laid.mapInArrow(_linked, "a long, b long").distinct(), "links")
    discard(groups)
    return found


def classes(rows: DataFrame) -> DataFrame:
    """(row, class) of every row of prints(); a class is named by one of its nodes."""
    close = fingerprint_links(rows)
    free_shuffles(rows.sparkSession)
    found = links(rows)
    roots = components(close.union(found))
    discard(close, found)
    del close, found
    free_shuffles(rows.sparkSession)
    return rows.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("class"))
