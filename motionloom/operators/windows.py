"""Ordering and window operators over samples of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trial(key: list[str]):
    return Window.partitionBy(*key)


def indexed(df: DataFrame, key: list[str], order: list[str], name: str = "i") -> DataFrame:
    """The place of each row in its trial, from 0."""
    return df.withColumn(name, F.row_number().over(_trial(key).orderBy(*order)) - 1)


def first_per_time(df: DataFrame, key: list[str], time: str, tie: str) -> DataFrame:
    """One row per time: the first by the tie column."""
    w = _trial([*key, time]).orderBy(tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gap_filled(df: DataFrame, key: list[str], index: str, value: str, limit: int = 5, out: str = "filled") -> DataFrame:
    """Linear fill by place, at most `limit` deep from each side; ends are held as deep."""
    past = _trial(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _trial(key).orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_p", F.last(known, ignorenulls=True).over(past)).withColumn("_q", F.first(known, ignorenulls=True).over(ahead))
    i = F.col(index)
    near = ((i - F.col("_p.i")) <= limit) | ((F.col("_q.i") - i) <= limit)
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (i - F.col("_p.i")) / (F.col("_q.i") - F.col("_p.i"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(near, F.when(F.col("_p").isNull(), F.col("_q.v")).when(F.col("_q").isNull(), F.col("_p.v")).otherwise(line))
    return df.withColumn(out, filled).drop("_p", "_q")


def sequence_filled(df: DataFrame, key: list[str], index: str, value: str, limit: int = 5, out: str = "filled") -> DataFrame:
    """Gap fill, then the trial's mean, then 0."""
    df = gap_filled(df, key, index, value, limit, "_f")
    return df.withColumn(out, F.coalesce("_f", F.avg("_f").over(_trial(key)), F.lit(0.0))).drop("_f")


def sampling_step(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """Median step between times of a trial, and the rate."""
    steps = df.withColumn("_d", F.col(time) - F.lag(time).over(_trial(key).orderBy(time)))
    return steps.groupBy(*key).agg(F.median("_d").alias("step")).withColumn("fs", F.when(F.col("step") > 0, 1 / F.col("step")))


def resampled(df: DataFrame, key: list[str], time: str, value: str, step: float) -> DataFrame:
    """Linear interpolation by time at first time + j * step, up to half a step beyond the last time, where the last value is held."""
    span = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(time).alias("_a"), F.max(time).alias("_z"))
    grid = span.select(*key, F.explode(F.sequence(F.lit(0), F.ceil((F.col("_z") - F.col("_a")) / step + 0.5).cast("int") - 1)).alias("j"), "_a").select(*key, "j", (F.col("_a") + F.col("j") * step).alias("t"), F.lit(None).cast("double").alias("v"))
    known = df.where(F.col(value).isNotNull()).select(*key, F.lit(None).cast("int").alias("j"), F.col(time).alias("t"), F.col(value).alias("v"))
    sample = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    w = _trial(key).orderBy("t", F.col("j").isNotNull())
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), _trial(key).orderBy("t", F.col("j").isNull()).rowsBetween(0, Window.unboundedFollowing)
    both = known.unionByName(grid).withColumn("p", F.last(sample, ignorenulls=True).over(past)).withColumn("q", F.first(sample, ignorenulls=True).over(ahead))
    same = F.col("p.t") == F.col("q.t")
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))
    value_ = F.when(F.col("q").isNull() | same, F.col("p.v")).when(F.col("p").isNull(), F.col("q.v")).otherwise(line)
    return both.where("j is not null").select(*key, "j", "t", value_.alias("v"))


def gradient(df: DataFrame, key: list[str], index: str, value: str, step: float, out: str = "gradient") -> DataFrame:
    """Central differences on a uniform grid, one-sided at the ends."""
    w = _trial(key).orderBy(index)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    g = F.when(before.isNull(), (after - F.col(value)) / step).when(after.isNull(), (F.col(value) - before) / step).otherwise((after - before) / (2 * step))
    return df.withColumn(out, g)


def second_difference(df: DataFrame, key: list[str], index: str, value: str, step: float, out: str = "jerk") -> DataFrame:
    w = _trial(key).orderBy(index)
    return df.withColumn(out, (F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)) / (step * step))


def sliding(df: DataFrame, key: list[str], index: str, value: str, size: int, hop: int) -> DataFrame:
    """(key, window, n, mean) of full windows of `size` samples every `hop`; each sample is sent only to its windows."""
    n = F.count("*").over(_trial(key))
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / F.lit(float(hop)))).cast("int")
    last = F.least(F.floor(F.col(index) / F.lit(float(hop))), F.floor((F.col("_n") - size) / F.lit(float(hop)))).cast("int")
    each = df.withColumn("_n", n).where(F.col("_n") >= size).withColumn("_f", first).withColumn("_l", last).where("_f <= _l")
    return each.withColumn("window", F.explode(F.sequence("_f", "_l"))).groupBy(*key, "window").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def zscore(value: Column | str, group: list[str]) -> Column:
    """Within-group z with the population SD; null under two values or without spread."""
    v = F.col(value) if isinstance(value, str) else value
    w = _trial(group)
    sd = F.stddev_pop(v).over(w)
    return F.when((F.count(v).over(w) >= 2) & (sd > 0), (v - F.avg(v).over(w)) / sd)


def average_rank(value: str, group: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    return F.rank().over(_trial(group).orderBy(value)) + (F.count("*").over(_trial([*group, value])) - 1) / 2.0


def duplicated(key: list[str]) -> Column:
    return F.count("*").over(_trial(key)) > 1


def numbered(df: DataFrame, by: list[str], buckets: list[Column], order: list[Column | str], out: str = "n") -> DataFrame:
    """Row number from 1 within `by`, in the order of (buckets, order), without sorting a whole group in one task.

    A bucket's rows are sorted by themselves; what comes before it is known from the
    counts of buckets, of which there are few.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    df = df.withColumns(dict(zip(names, buckets, strict=True)))
    counts = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(_trial(by).orderBy(*names)) - F.col("_c")
    places = counts.select(*by, *names, before.alias("_before"))
    keyed = [*by, *names]
    numbers = df.withColumn("_own", F.row_number().over(_trial(keyed).orderBy(*order)))
    right = places.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keyed)), "_before")
    on = F.lit(True)
    for i, k in enumerate(keyed):
        on = on & numbers[k].eqNullSafe(right[f"_r{i}"])
    joined = numbers.join(right, on)
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", *names, *(f"_r{i}" for i in range(len(keyed))))


def value_ranks(counts: DataFrame, by: list[str], value: str, weight: str, out: str = "upto", parts: int = 64) -> DataFrame:
    """Running sum of weights over the values of a group, one row per value, in `parts` ranges of values.

    The ranges come from approximate quantiles; they decide only what a task sorts.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    placed = counts.join(cuts, by).withColumn("_part", part).drop("_cuts")
    sums = placed.groupBy(*by, "_part").agg(F.sum(weight).alias("_w")).withColumn("_before", F.sum("_w").over(_trial(by).orderBy("_part")) - F.col("_w")).drop("_w")
    own = F.sum(weight).over(_trial([*by, "_part"]).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(sums, [*by, "_part"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def ranked(df: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """Position after sorting a report of features by score, best first."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), tie)))


def top(df: DataFrame, score: str, tie: str, n: int = 10, best: bool = True, absolute: bool = False) -> DataFrame:
    """The n best (or worst) rows by score, or by its absolute value; ties by `tie`."""
    by = F.abs(score) if absolute else F.col(score)
    return df.orderBy(by.desc_nulls_last() if best else by.asc_nulls_last(), tie).limit(n)
