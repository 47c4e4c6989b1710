"""Keyed joins with checks, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.functions.scalars import block, condition, participant


def require_unique(df: DataFrame, key: list[str], what: str) -> DataFrame:
    bad = df.groupBy(*key).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{what}: duplicate keys {[tuple(r)[:-1] for r in bad]}")
    return df


def standard_keys(df: DataFrame) -> DataFrame:
    """participant_id, condition and block in standard form; a missing one is an error."""
    df = df.withColumns({"participant_id": participant(F.col("participant_id")), "condition": condition(F.col("condition")), "block": block(F.col("block"))})
    if not df.where("participant_id is null or condition is null or block is null").isEmpty():
        raise ValueError("null merge keys")
    return df


def many_to_one(left: DataFrame, right: DataFrame, key: list[str], suffix: str = "_meta", matched: str | None = "matched") -> DataFrame:
    """Left join on a unique right key; clashing right columns get the suffix."""
    require_unique(right, key, "right side")
    clash = [x for x in right.columns if x in left.columns and x not in key]
    for x in clash:
        right = right.withColumnRenamed(x, x + suffix)
    right = right.withColumn("_hit", F.lit(True))
    out = left.join(right, key, "left")
    return (out.withColumn(matched, F.coalesce("_hit", F.lit(False))) if matched else out).drop("_hit")


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side they are on."""
    l, r = left.select(*key).distinct(), right.select(*key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).union(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def merged_block_features(trials: DataFrame, tables: dict[str, DataFrame], wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Left joins of block tables on (participant_id, condition, block), and the unmatched rows with their table's name.

    `wanted` names the features to take, each from the first table that has it; one that
    none has is an error, as are repeated keys and a table without blocks.
    """
    keys, out, missing = ["participant_id", "condition", "block"], standard_keys(trials), None
    clash = [x for x in wanted or [] if x in out.columns]
    if clash:
        raise ValueError(f"the trials have these columns already: {clash}")
    for name, t in tables.items():
        if "block" not in t.columns:
            raise ValueError(f"{name}: a table without block would leak participant averages into trials")
        fresh = [x for x in t.columns if x not in keys and x not in out.columns and (wanted is None or x in wanted)]
        if not fresh:
            continue
        t = standard_keys(t)
        lost = out.join(t, keys, "left_anti").select(F.lit(name).alias("table"), *keys)
        missing = lost if missing is None else missing.union(lost)
        out = many_to_one(out, t.select(*keys, *fresh), keys, matched=None)
    lack = [x for x in wanted or [] if x not in out.columns]
    if lack:
        raise ValueError(f"no table has {lack}")
    return out, missing


def outer_chain(tables: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Full outer joins in which null keys meet null keys; clashing columns get the table's suffix."""
    (_, out), *rest = tables
    for suffix, t in rest:
        t = t.select(*(F.col(x).alias(f"_k_{x}" if x in key else x + suffix if x in out.columns else x) for x in t.columns))
        on = None
        for k in key:
            same = out[k].eqNullSafe(t[f"_k_{k}"])
            on = same if on is None else on & same
        j = out.join(t, on, "full")
        out = j.select(*(F.coalesce(k, f"_k_{k}").alias(k) for k in key), *(x for x in j.columns if x not in key and not x.startswith("_k_")))
    return out


def pairs(df: DataFrame, key: list[str], item: str, cols: list[str]) -> DataFrame:
    """All unordered pairs of a key's few items (blocks of a participant, features of a report)."""
    a = df.select(*key, *(F.col(x).alias(f"{x}_1") for x in [item, *cols]))
    b = df.select(*key, *(F.col(x).alias(f"{x}_2") for x in [item, *cols]))
    return a.join(b, key).where(F.col(f"{item}_1") < F.col(f"{item}_2"))


def require_disjoint(a: DataFrame, b: DataFrame, what: str) -> None:
    if not a.intersect(b).isEmpty():
        raise ValueError(f"{what} are in both sides")


def lookup(left: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Dictionary lookup; the planner broadcasts the table where its size allows."""
    return left.join(table, key, how)


def only_within(df: DataFrame, group: str, columns: dict[str, list[str]]) -> DataFrame:
    """Columns that belong to one group are missing outside of it: {group: its columns}."""
    own = {x: F.when(condition(F.col(group)) == g, F.col(x)) for g, cols in columns.items() for x in cols if x in df.columns}
    return df.withColumns(own) if own else df
