"""Aggregates and statistical diagnostics, in long form (one row per feature and value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions.scalars import c, number
from motionloom.operators.windows import ranked, value_ranks


def long_form(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(ids, feature, value): the table that all diagnostics read; what is no number is missing."""
    values = F.array(*(F.struct(F.lit(f).alias("feature"), number(c(f)).alias("value")) for f in features))
    return df.select(*ids, F.explode(values).alias("_e")).select(*ids, "_e.feature", "_e.value")


def duration(time: str, rate: float = 50.0) -> Column:
    """Seconds between first and last time; rows over rate where times tell nothing; null under two rows."""
    return F.when((F.count(time) >= 2) & (F.max(time) > F.min(time)), F.max(time) - F.min(time)).when(F.count(F.lit(1)) >= 2, F.count(F.lit(1)) / rate)


def range_of_motion(df: DataFrame, key: list[str], time: str, signals: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows"), duration(time).alias("duration")]
    for s in signals:
        aggs.append((F.max(s) - F.min(s)).alias(f"ROM_{s}"))
    out = df.groupBy(*key).agg(*aggs)
    return out.withColumns({f"ROM_rate_{s}": F.try_divide(F.col(f"ROM_{s}"), F.when(F.col("duration") > 0, F.col("duration"))) for s in signals})


def across_trial_cv(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Population SD over mean across trials; null under two values or with mean 0."""
    aggs = [F.count(F.lit(1)).alias("n_trials")]
    for f in features:
        aggs.append(F.when((F.count(f) >= 2) & (F.avg(f) != 0), F.stddev_pop(f) / F.avg(f)).alias(f"CV_{f}"))
    return df.groupBy(*key).agg(*aggs)


def participant_means(df: DataFrame, key: list[str], features: list[str], block: str) -> DataFrame:
    """Means of features and number of blocks; rows with a null key are left out."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*key).agg(*(F.avg(f).alias(f) for f in features), F.count_distinct(block).alias("n_blocks"))


def missingness(long: DataFrame, limit: float = 0.30) -> DataFrame:
    n = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_total"), (F.count(F.lit(1)) - F.count("value")).alias("n_missing"))
    return n.withColumn("pct_missing", F.col("n_missing") / F.col("n_total")).withColumn("flag_high_missing", F.col("pct_missing") > limit)


def distributions(long: DataFrame, least_variance: float = 1e-8) -> DataFrame:
    a = long.groupBy("feature").agg(F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), F.var_pop("value").alias("variance"))
    return a.withColumn("flag_near_zero_variance", (F.col("n_valid") < 2) | (F.col("variance") < least_variance))


def _bounds(long: DataFrame, least: int) -> DataFrame:
    """Fences and moments of each feature with at least `least` values.

    Quartiles are exact: different values are counted, ranked in ranges of values, and
    the two beside each quartile's place are found by their running counts.
    """
    v = long.where(F.col("value").isNotNull())
    moments = v.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")).where(F.col("n") >= least)
    ranks = value_ranks(v.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t")), ["feature"], "value", "t").join(F.broadcast(moments), "feature")
    at = lambda q: (F.col("n") - 1) * q
    beside = [F.min(F.when(F.col("upto") > side(at(q)), F.col("value"))).alias(f"_{name}{k}") for k, q in (("1", 0.25), ("3", 0.75)) for name, side in (("a", F.floor), ("b", F.ceil))]
    b = ranks.groupBy("feature").agg(F.first("n").alias("n"), F.first("_m").alias("_m"), F.first("_s").alias("_s"), *beside)
    quartile = lambda k, q: F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (at(q) - F.floor(at(q)))
    b = b.withColumns({"_q1": quartile("1", 0.25), "_q3": quartile("3", 0.75)})
    iqr = F.col("_q3") - F.col("_q1")
    return b.select("feature", "n", (F.col("_q1") - 1.5 * iqr).alias("lower"), (F.col("_q3") + 1.5 * iqr).alias("upper"), "_m", "_s")


def outliers(long: DataFrame, ids: list[str], least: int = 4, z: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Summary per feature and detail per value: outside the 1.5 IQR fence, or more than z SD away."""
    b = _bounds(long, least)
    # a row for each feature: few
    marked = long.where("value is not null").join(F.broadcast(b), "feature").withColumns({"is_iqr": (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), "is_z": F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("_m"), F.when(F.col("_s") > 0, F.col("_s")))) > z, F.lit(False))})
    summary = marked.groupBy("feature").agg(F.count(F.lit(1)).alias("n_valid"), F.sum(F.col("is_iqr").cast("long")).alias("n_iqr"), F.sum(F.col("is_z").cast("long")).alias("n_z"), F.first("lower").alias("lower"), F.first("upper").alias("upper")).withColumns({"pct_iqr": F.col("n_iqr") / F.col("n_valid"), "pct_z": F.col("n_z") / F.col("n_valid")})
    return summary, marked.where("is_iqr or is_z").select(*ids, "feature", "value", "is_iqr", "is_z")


def anova(long: DataFrame, label: str, scope: list[str] | None = None) -> DataFrame:
    """One-way F, its degrees of freedom and eta squared of each feature over a label, from sums.

    Sums of squares are taken about the feature's mean, for precision. Classes of
    under two rows are left out.
    """
    by = [*(scope or []), "feature"]
    v = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    g = v.groupBy(*by, label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).where("n >= 2")
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.alias("g").join(t.select(*by, "mean"), by).groupBy(*by).agg(F.sum(F.col("g.n") * (F.col("m") - F.col("mean")) ** 2).alias("between"))
    out = t.join(between, by)
    msb, msw = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))
    ok = (F.col("k") >= 2) & (F.col("n") > F.col("k")) & (F.col("within") > 0)
    return out.select(*by, "n", "k", F.when(ok, msb / msw).alias("f"), F.when(F.col("within") + F.col("between") > 0, F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"))


def kruskal(long: DataFrame, label: str) -> DataFrame:
    """H with tie correction, over classes of at least two rows. Ranks come from counts of
    each different value, ranked in ranges of values, so no task orders a whole feature."""
    v = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    counts = v.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("c"))
    # a row for each feature and class: few
    kept = counts.groupBy("feature", label).agg(F.sum("c").alias("_n")).where("_n >= 2").select("feature", label)
    counts = counts.join(F.broadcast(kept), ["feature", label], "left_semi")
    each = counts.groupBy("feature", "value").agg(F.sum("c").alias("t"))
    each = value_ranks(each, ["feature"], "value", "t").withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0)
    sums = counts.join(each.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", label).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    n = F.col("N").cast("double")
    total = sums.groupBy("feature").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = each.groupBy("feature").agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    correction = 1 - F.try_divide(F.col("ties"), n**3 - n)
    return total.join(ties, "feature").select("feature", F.col("N").alias("n"), "k", F.when((F.col("k") >= 2) & (correction > 0), (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / correction).alias("h"))


def residualized(df: DataFrame, value: str, by: str, out: str = "residual") -> DataFrame:
    """What a straight line in `by` leaves of `value`; the fit is one row, joined as such."""
    fit = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).agg(F.regr_slope(value, by).alias("_b"), F.regr_intercept(value, by).alias("_a"))
    fit = fit.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(fit), "_one").drop("_one").withColumn(out, F.col(value) - F.col("_a") - F.col("_b") * F.col(by)).drop("_a", "_b")


def pair_correlations(df: DataFrame, features: list[str], least: int = 5, group: str | None = None) -> list[tuple]:
    """(group, feature_1, feature_2, n, r) of feature pairs with `least` complete rows; r is null where either stands still.

    One matrix of sums a batch holds values about their means, their presence and their
    squares, so pairs of many columns need no expression each.
    """
    from motionloom.operators.pca import gram

    size = len(features)
    m = df.agg(*(F.avg(c(f)).alias(f"m{i}") for i, f in enumerate(features))).first() if features else []
    groups = [r[0] for r in df.select(group).distinct().collect()] if group else [None]
    x = [c(f).cast("double") - F.lit(float(v)) if v is not None else F.lit(None).cast("double") for f, v in zip(features, m, strict=True)]
    cells = [F.coalesce(v, F.lit(0.0)) for v in x] + [v.isNotNull().cast("double") for v in x] + [F.coalesce(v * v, F.lit(0.0)) for v in x]
    number_of = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).cast("int") if group and None not in groups else F.lit(1)
    if group and None in groups:  # rows without a group are left out
        groups = [g for g in groups if g is not None]
        df = df.where(F.col(group).isNotNull())
        number_of = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).cast("int")
    sums: dict[int, np.ndarray] = {}
    for r in gram(df.select(F.array(*cells).alias("v"), number_of.alias("g")), "v", 3 * size, "g").collect() if size else []:
        sums.setdefault(r["by"], np.zeros((3 * size + 1) ** 2))[r["pos"]] = r["sum"]
    out = []
    for g, s in sorted(sums.items()):
        s = s.reshape(3 * size + 1, 3 * size + 1)
        n, one, two = s[size : 2 * size, size : 2 * size], s[:size, size : 2 * size], s[2 * size : 3 * size, size : 2 * size]
        var = n * two - one * one
        var[var <= 1e-12 * np.maximum(n * two, 1e-300)] = 0
        both = n * s[:size, :size] - one * one.T
        with np.errstate(divide="ignore", invalid="ignore"):
            r = both / np.sqrt(var * var.T)
        out += [(groups[g - 1], features[i], features[j], int(n[i, j]), float(r[i, j]) if np.isfinite(r[i, j]) else None) for i in range(size) for j in range(i + 1, size) if n[i, j] >= least]
    return out


def correlations(df: DataFrame, features: list[str], least: int = 5) -> DataFrame:
    """Pairwise-complete Pearson r of feature pairs, in one pass over the table."""
    return df.sparkSession.createDataFrame([r[1:] for r in pair_correlations(df, features, least)], "feature_1 string, feature_2 string, n long, r double")


def redundant(df: DataFrame, features: list[str], limit: float = 0.90) -> DataFrame:
    r = correlations(df, features).where("r is not null and not isnan(r)")
    return r.withColumn("absolute_correlation", F.abs("r")).withColumn("flag", F.col("absolute_correlation") >= limit)


def confound(long: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """ANOVA by group, with the groups' means as columns."""
    means = long.groupBy("feature").pivot(group, groups).agg(F.avg("value"))
    means = means.select("feature", *(F.col(f"`{g}`").alias(f"mean_{g}") for g in groups))
    return anova(long, group).select("feature", F.col("f").alias("instrument_f")).join(means, "feature", "left")


def composite(report: DataFrame) -> DataFrame:
    """Score and rank of features; a missing input counts as zero or false."""
    flag = lambda x: F.coalesce(F.col(x), F.lit(False)).cast("double")
    score = 10 * F.coalesce("mutual_info", F.lit(0.0)) + flag("significant") - 5 * flag("flag_near_zero_variance") - 3 * flag("flag_high_missing") - F.when(F.coalesce("pct_iqr", F.lit(0.0)) > 0.10, 1.0).otherwise(0.0) - 0.5 * flag("confounded")
    return ranked(report.withColumn("score", score), "score", "feature")


def confusion(df: DataFrame, truth: str, predicted: str, classes: list, scope: list[str] | None = None) -> DataFrame:
    """Counts of every pair of classes, zeros included."""
    scope = scope or []
    kinds = {k: df.schema[k].dataType for k in (truth, predicted)}
    cells = F.array(*(F.struct(F.lit(a).cast(kinds[truth]).alias(truth), F.lit(b).cast(kinds[predicted]).alias(predicted)) for a in classes for b in classes))
    grid = (df.select(*scope).distinct() if scope else df.sparkSession.range(1)).select(*scope, F.explode(cells).alias("_c")).select(*scope, "_c.*")
    n = df.groupBy(*scope, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [*scope, truth, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def metrics(matrix: DataFrame, truth: str, predicted: str, scope: list[str] | None = None) -> DataFrame:
    """Per class precision, recall, F1 and support; 0 where a division has no meaning."""
    scope = scope or []
    m = matrix.withColumnRenamed(truth, "_t").withColumnRenamed(predicted, "_p")
    hit = F.sum(F.when(F.col("_t") == F.col("_p"), F.col("n")).otherwise(0))
    t = m.groupBy(*scope, F.col("_t").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = m.groupBy(*scope, F.col("_p").alias("class")).agg(F.sum("n").alias("said"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = t.join(p, [*scope, "class"]).withColumn("precision", zero(F.col("hits"), F.col("said"))).withColumn("recall", zero(F.col("hits"), F.col("support")))
    f1 = zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return j.withColumn("f1", f1).select(*scope, "class", "support", "said", "precision", "recall", "f1")


def overall(per_class: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Balanced accuracy over classes that occur, macro F1 over those that occur or are predicted, weighted F1."""
    return per_class.groupBy(*(scope or [])).agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(F.col("support") + F.col("said") > 0, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float | None, k: float, n: float) -> float | None:
    return None if f is None or f < 0 else beta_tail(n / (n + k * f), n / 2, k / 2)


def t_tail(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_tail(1 - r * r, (n - 2) / 2, 0.5)


def chi2_tail(x: float | None, k: float) -> float | None:
    if x is None:
        return None
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def with_tails(report: DataFrame) -> DataFrame:
    """p values of F, H and r columns where they stand; reports are short, one row per feature."""
    rows, fields = report.collect(), report.schema
    out = []
    for r in rows:
        d = r.asDict()
        d["p"] = f_tail(d["f"], d["k"] - 1, d["n"] - d["k"]) if "f" in d else chi2_tail(d["h"], d["k"] - 1) if "h" in d else t_tail(d["r"], d["n"])
        out.append(tuple(d.values()))
    return report.sparkSession.createDataFrame(out, fields.add("p", "double"))

