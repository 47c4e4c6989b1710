"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

Texts are lower-cased and cut into runs of letters and digits. A mask hashes the
tokens at its '1' positions and ignores the others, so one or two substituted
tokens do not hide an overlap: in any WINDOW aligned tokens of which at least
NEEDED are equal, one of MASKS fits between the differing ones (checked over all
placements in the tests). Hashes of documents meet those of the benchmark; at
each hit document and item are laid over each other on the hit's diagonal and
compared token by token. A document is contaminated by an item if some WINDOW
aligned tokens hold NEEDED equal ones; items shorter than WINDOW must occur whole.

The benchmark's seeds are broadcast while they number at most MAX_SEEDS, a size
that is counted first; a larger benchmark is joined by shuffling the hashes.

Cases: null or empty text or item: never matches; null keys are returned as they
are; repeated rows count as one document; empty tables: no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import materialize

WINDOW, NEEDED = 13, 11
MASKS = ("11101011", "110100111")
MAX_SEEDS, MAX_KEYS = 500_000, 1_000_000
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_TOKEN), "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(h: Column, at: Column, masks: list[str]) -> Column:
    """For each mask that fits at this place: its number and the hash of the tokens it looks at."""
    one = lambda i, m: F.when(at + len(m) <= F.size(h), F.xxhash64(F.lit(i), *(F.get(h, at + k) for k, c in enumerate(m) if c == "1")))
    return F.array(*(one(i, m) for i, m in enumerate(masks)))


def _placed(df: DataFrame, masks: list[str]) -> DataFrame:
    """Each place of each row with its seeds' hashes; df has h, the tokens' hashes."""
    places = df.withColumn("at", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))))
    return places.withColumn("seed", F.explode(_seeds(F.col("h"), F.col("at"), masks))).where("seed is not null")


def _best_window(equal: Column, window: int) -> Column:
    """The largest number of equal tokens in `window` places one after another."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        last = F.shiftleft(acc["last"], 1).bitwiseOR(x.cast("long")).bitwiseAND(F.lit((1 << window) - 1))
        return F.struct(last.alias("last"), F.greatest(acc["best"], F.bit_count(last)).alias("best"))

    return F.aggregate(equal, start, step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_id, item_id, item_tokens, equal_tokens, places): verified overlaps, one row per document and item.

    equal_tokens is the most equal tokens of any verified diagonal, places the number of those diagonals.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), hashes(F.col(item_text).cast("string")).alias("item_h")).where("size(item_h) > 0")
    sizes = items.agg(F.sum(F.size("item_h")), F.array_sort(F.collect_set(F.when(F.size("item_h") < WINDOW, F.size("item_h"))))).first()
    masks = [*MASKS, *("1" * n for n in sizes[1] or [])]
    seeds = _placed(items.withColumnRenamed("item_h", "h"), masks).select("seed", "item_id", F.col("at").alias("item_at"), F.size("h").alias("n"))
    # a short item has a mask of its own, and a long one needs none of those
    few = docs.select(F.col(key).cast("long").alias("doc_id"), hashes(F.col(text).cast("string")).alias("h"))
    start = (F.col("at") - F.col("item_at")).alias("start")
    if (sizes[0] or 0) * len(masks) <= max_seeds:
        hits = _placed(few, masks).join(F.broadcast(seeds), "seed")
        segment = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("h"), F.col("at") - F.col("item_at") + i)).alias("segment")
        laid = hits.select("doc_id", "item_id", start, segment).join(F.broadcast(items), "item_id")
    else:
        # rows are told apart by their tokens too, so rows of one key or without any don't meet each other's hits
        rows = few.withColumn("own", F.xxhash64("h"))
        hits = _placed(rows, masks).select("doc_id", "own", "at", "seed").join(seeds, "seed").select("doc_id", "own", "item_id", "n", start).distinct()
        segment = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("h"), F.col("start") + i)).alias("segment")
        once = rows.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.first("h").alias("h"))
        laid = hits.join(once, (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "item_id", "start", segment).join(items, "item_id")
    equal = F.zip_with("segment", "item_h", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    judged = laid.select("doc_id", "item_id", "start", F.size("item_h").alias("item_tokens"), equal.alias("equal"))
    judged = judged.select("doc_id", "item_id", "start", "item_tokens", F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("same"), _best_window(F.col("equal"), WINDOW).alias("best"))
    good = judged.where(F.when(F.col("item_tokens") < WINDOW, F.col("same") == F.col("item_tokens")).otherwise(F.col("best") >= NEEDED))
    diagonals = good.groupBy("doc_id", "item_id", "item_tokens", "start").agg(F.max("same").alias("same"))
    return diagonals.groupBy("doc_id", "item_id", "item_tokens").agg(F.max("same").cast("int").alias("equal_tokens"), F.count("*").alias("places"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs without those that overlap an item; their columns stay.

    The overlapping keys are written and counted first: few are broadcast, so that texts
    are not shuffled to leave them out; beyond MAX_KEYS the join is left to the planner.
    """
    bad = materialize(overlaps(docs, benchmark, key).select(F.col("doc_id").alias("_bad")).distinct(), "overlapping")
    bad = F.broadcast(bad) if bad.count() <= MAX_KEYS else bad
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["_bad"]), "left_anti")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark),
dw AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS q, len(t) AS n FROM i),
eq AS (SELECT doc_id, item_id, n, p - q AS start, q FROM dw JOIN iw USING (w)),
run AS (SELECT doc_id, item_id, n, start, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY q RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS same FROM eq),
dia AS (SELECT doc_id, item_id, start, max(n) AS n, count(*) AS same, max(same) AS best FROM run GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_tokens, CAST(max(same) AS INTEGER) AS equal_tokens, count(*) AS places
FROM dia WHERE CASE WHEN n < {WINDOW} THEN same = n ELSE best >= {NEEDED} END GROUP BY doc_id, item_id, n
"""
