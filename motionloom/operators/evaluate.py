"""Feature choice by configuration, skill/duration evaluation and the report bundle of each scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from motionloom.functions import scalars as S
from motionloom.operators import stats

# Columns that are no features, features known to stand still, and the sets of features by configuration.
NOT_FEATURES = {"participant_id", "condition", "block", "instrument", "file", "status", "error", "n_rows", "trial_duration_seconds", "mean_block_duration_seconds", "n_trials", "Skill Level", "skill_level", "skill_group", "Num Level", "Age", "Sex", "ID", "Instrument", "excluded"}
STILL = {"ROM_RElbowAngles_X", "ROM_RElbowAngles_Z", "ROM_LElbowAngles_X", "ROM_LElbowAngles_Z", "ROM_rate_RElbowAngles_X", "ROM_rate_RElbowAngles_Z", "ROM_rate_LElbowAngles_X", "ROM_rate_LElbowAngles_Z", "ROM_rate_Spine4Angles_X", "ROM_Spine4Angles_Y"}
SHARED = {"PCA16_lower_body_mean_sd", "PCA16_trunk_head_mean_sd", "PCA16_upper_body_mean_sd", "PCA12a_PM1_rms", "PCA12a_PM2_rms", "PCA12a_PM7_rms"}
OWN = {
    "clarinet": {"PCA11b_within_participant_consistency", "PCA12a_PM4_rms", "SPARC_window_median_LWrist", "LDJ_stroke_mean_LWrist", "LDJ_stroke_sd_LWrist"},
    "violin": {"PCA12a_PM6_rms", "SPARC_window_bow_elbow_all_median"},
}
POSTURE = {"clarinet": {"WEISS_knee_angle_sd", "WEISS_arm_angle_sd"}}
CONFIGS = ("baseline", "shared_pca", "instrument_specific", "instrument_specific_weiss")
SEPARATE = ("instrument_specific", "instrument_specific_weiss")
COMPARED = ["rank", "score", "mutual_info", "p"]
FEATURE_SETS = {"raw_only": lambda n: not n.endswith("_z"), "z_only": lambda n: n.endswith("_z"), "all": lambda n: True}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in NOT_FEATURES and not f.name.startswith("QC_")]


def _baseline(name: str) -> bool:
    return name.startswith(("ROM_", "LDJ_stroke_")) and not name.startswith("ROM_rate_")


def diagnostic_features(df: DataFrame, feature_set: str = "raw_only") -> list[str]:
    """Numeric columns that the diagnostics read, in the table's order."""
    return [n for n in _numeric(df) if not n.endswith("_valid_frames") and FEATURE_SETS[feature_set](n)]


def model_features(df: DataFrame, config: str, instrument: str | None = None) -> list[str]:
    """Sorted columns that a model reads; an instrument's own ones join only where one instrument is modelled alone."""
    if config not in CONFIGS:
        raise ValueError(f"no such feature configuration: {config}")
    extra = set() if config == "baseline" else SHARED
    if config in SEPARATE and instrument:
        extra = extra | OWN.get(instrument, set()) | (POSTURE.get(instrument, set()) if config == "instrument_specific_weiss" else set())
    return sorted({n for n in _numeric(df) if n not in STILL and not n.endswith(("_z", "_valid_frames")) and (_baseline(n) or n in extra)})


def supported_features(df: DataFrame, features: list[str], instrument: str = "instrument", least: int = 2) -> list[str]:
    """Features that every instrument has `least` values of: a constant put for the others would tell the instrument."""
    if not features:
        return []
    few = df.groupBy(instrument).agg(*(F.count(S.number(S.c(f))).alias(f"n{i}") for i, f in enumerate(features)))
    n = few.agg(*(F.min(f"n{i}").alias(f"n{i}") for i in range(len(features)))).first()
    return [f for i, f in enumerate(features) if (n[i] or 0) >= least]


def model_rows(df: DataFrame, target: str, task: str, one_label: bool = False) -> DataFrame:
    """Rows that a model of the task reads: successful ones with a class and an instrument; `label` holds the class.

    With `one_label` a participant of several classes is an error.
    """
    if "status" in df.columns:
        df = df.where("status = 'ok'")
    df = df.withColumn("label", S.task_label(S.c(S.find_column(df.columns, target)), task))
    df = df.where("label is not null and instrument is not null").withColumns({"instrument": S.condition(F.col("instrument")), "participant_id": S.participant(F.col("participant_id"))})
    if one_label:
        from motionloom.operators.learn import require_one_label

        require_one_label(df, "participant_id", "label")
    return df


def support(long: DataFrame, scope: list[str] | None = None, least: int = 2) -> DataFrame:
    """Per feature the fewest valid values of any group of the scope, and whether they suffice.

    A feature that a group has no row of counts as zero only if the long table holds its nulls.
    """
    n = long.groupBy(*(scope or []), "feature").agg(F.count("value").alias("n"))
    return n.groupBy("feature").agg(F.min("n").alias("least_valid")).withColumn("kept", F.col("least_valid") >= least)


def skill_duration(long: DataFrame, scope: list[str], label: str, duration: str, least: int = 10) -> DataFrame:
    """Per scope and feature: correlation with duration, ANOVA over labels, and ANOVA of what a line in duration leaves.

    One pass takes counts, means and central moments of each label; all sums of squares
    come from these, so values are shuffled neither for the line nor for its residuals.
    Labels of one row count for the line, but not for the ANOVA.
    """
    by = [*scope, "feature"]
    v = long.where(F.col("value").isNotNull() & F.col(duration).isNotNull() & F.col(label).isNotNull())
    g = v.groupBy(*by, label).agg(F.count("value").alias("n"), F.avg("value").alias("x"), F.avg(duration).alias("d"), F.var_pop("value").alias("vx"), F.var_pop(duration).alias("vd"), F.covar_pop("value", duration).alias("c"))
    w = Window.partitionBy(*by)
    total = lambda e: F.sum(F.col("n") * e).over(w)
    g = g.withColumns({"all": F.sum("n").over(w), "levels": F.count(F.lit(1)).over(w)})
    g = g.withColumns({"x": F.col("x") - total(F.col("x")) / F.col("all"), "d": F.col("d") - total(F.col("d")) / F.col("all")})
    g = g.withColumns({"sx": total(F.col("vx") + F.col("x") ** 2), "sd": total(F.col("vd") + F.col("d") ** 2), "sxd": total(F.col("c") + F.col("x") * F.col("d"))})
    g = g.withColumn("b", F.coalesce(F.when(F.col("sd") > 0, F.try_divide("sxd", "sd")), F.lit(0.0)))
    g = g.withColumns({"rx": F.col("x") - F.col("b") * F.col("d"), "rv": F.greatest(F.lit(0.0), F.col("vx") - 2 * F.col("b") * F.col("c") + F.col("b") ** 2 * F.col("vd"))})
    kept = F.col("n") >= 2
    part = lambda e: F.sum(F.when(kept, F.col("n") * e))
    sums = [F.first("all").alias("n_participants"), F.first("levels").alias("levels"), F.first(F.try_divide(F.col("sxd"), F.sqrt(F.col("sx") * F.col("sd")))).alias("duration_r"), part(F.lit(1)).alias("m"), F.sum(F.when(kept, 1)).alias("k")]
    for name, mean, var in (("raw", "x", "vx"), ("residual", "rx", "rv")):
        sums += [(part(F.col(mean) ** 2) - F.try_divide(part(F.col(mean)) ** 2, part(F.lit(1)))).alias(f"{name}_b"), part(F.col(var)).alias(f"{name}_w")]
    t = g.groupBy(*by).agg(*sums).where((F.col("n_participants") >= least) & (F.col("levels") >= 2))
    f = lambda s: F.when((F.col("k") >= 2) & (F.col("m") > F.col("k")) & (F.col(f"{s}_w") > 0), (F.col(f"{s}_b") / (F.col("k") - 1)) / (F.col(f"{s}_w") / (F.col("m") - F.col("k"))))
    eta = F.when(F.col("k") >= 2, F.try_divide(F.col("raw_b"), F.col("raw_b") + F.col("raw_w")))
    return t.select(*by, "n_participants", F.col("m").alias("n_anova"), F.col("k").alias("k_anova"), "duration_r", f("raw").alias("raw_f"), eta.alias("raw_eta_squared"), f("residual").alias("residual_f"))


def skill_duration_tails(report: DataFrame) -> DataFrame:
    """The report with p values of r and both F; one row for each scope and feature, so it is short."""
    out = []
    for r in report.collect():
        d = r.asDict()
        tail = lambda f, d=d: None if f is None else stats.f_tail(f, d["k_anova"] - 1, d["n_anova"] - d["k_anova"])
        out.append((*d.values(), stats.t_tail(d["duration_r"], d["n_participants"]), tail(d["raw_f"]), tail(d["residual_f"])))
    fields = report.schema
    for p in ("duration_p", "raw_p", "residual_p"):
        fields = fields.add(p, "double")
    return report.sparkSession.createDataFrame(out, fields)


def redundancy_by(df: DataFrame, scope: str, features: list[str], least: int = 5, limit: float = 0.90) -> DataFrame:
    """Pearson r of feature pairs in each group of the scope, complete pairs only, in one pass."""
    kind = df.schema[scope].dataType.simpleString()
    rows = [r for r in stats.pair_correlations(df, features, least, scope) if r[4] is not None]
    out = df.sparkSession.createDataFrame(rows, f"{scope} {kind}, feature_1 string, feature_2 string, n_participants long, r double")
    return out.withColumn("flag", F.abs("r") >= limit)


def discriminative(long: DataFrame, label: str, least: int = 10) -> DataFrame:
    """ANOVA, Kruskal-Wallis and mutual information over labels, of features with `least`
    values and two classes of two rows or more; `significant` tells p under 0.05."""
    from motionloom.operators.features import mutual_information

    v = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    sizes = v.groupBy("feature", label).agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(F.sum("c").alias("n_valid"), F.count_if(F.col("c") >= 2).alias("k"))
    # a row for each feature: few
    fit = F.broadcast(sizes.where((F.col("n_valid") >= least) & (F.col("k") >= 2)).select("feature", "n_valid"))
    v = v.join(fit.select("feature"), "feature", "left_semi")
    f = stats.with_tails(stats.anova(v, label)).select("feature", "f", "p", "eta_squared")
    h = stats.with_tails(stats.kruskal(v, label)).select("feature", "h", F.col("p").alias("h_p"))
    out = fit.join(f, "feature", "left").join(h, "feature", "left").join(mutual_information(v, label), "feature", "left")
    return out.withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def bundle(df: DataFrame, ids: list[str], features: list[str], label: str, instrument: str, instruments: list[str], per_instrument: bool = True) -> dict[str, DataFrame]:
    """The diagnostic tables by name; the column `scope` tells overall rows from those of one instrument.

    `comparison` holds the instruments' ranks, scores and tests of a feature side by side.
    """
    tables: dict[str, DataFrame] = {}
    for scope in ["overall", *(instruments if per_instrument else [])]:
        d = df if scope == "overall" else df.where(F.col(instrument) == scope)
        long = stats.long_form(d, [*dict.fromkeys([*ids, label, instrument])], features)
        summary, detail = stats.outliers(long, ids)
        power = discriminative(long, label)
        confounds = stats.with_tails(stats.anova(long, instrument)).select("feature", F.col("f").alias("instrument_f"), F.col("p").alias("instrument_p"), (F.col("p") < 0.05).alias("confounded")) if scope == "overall" else None
        r = ranking(stats.missingness(long), stats.distributions(long), summary, power, confounds)
        own = {"missingness": stats.missingness(long), "distributions": stats.distributions(long), "outlier_summary": summary, "outlier_detail": detail, "discriminative": power, "correlations": stats.correlations(d, features), "redundancy": stats.redundant(d, features).where("flag"), "ranking": r}
        if confounds is not None:
            own["confounds"] = confounds
        for name, t in own.items():
            t = t.withColumn("scope", F.lit(scope))
            tables[name] = tables[name].unionByName(t) if name in tables else t
    if per_instrument and instruments:
        tables["comparison"] = compared(tables["ranking"], instruments)
    return tables


def ranking(missing: DataFrame, spread: DataFrame, outliers: DataFrame, power: DataFrame, confounds: DataFrame | None) -> DataFrame:
    """All inputs by feature, scored and ranked; what an input lacks of a feature is null or false."""
    r = missing.join(spread, "feature", "left").join(outliers.select("feature", "pct_iqr"), "feature", "left").join(power.drop("n_valid"), "feature", "left")
    r = r.join(confounds.select("feature", "confounded"), "feature", "left") if confounds is not None else r.withColumn("confounded", F.lit(False))
    return stats.composite(r)


def compared(ranked: DataFrame, scopes: list[str]) -> DataFrame:
    """One row a feature with each scope's rank, score and tests as columns; a feature of one scope only stays."""
    out = None
    for s in scopes:
        t = ranked.where(F.col("scope") == s).select("feature", *(F.col(x).alias(f"{s}_{x}") for x in COMPARED))
        out = t if out is None else out.join(t, "feature", "full")
    return out


def correlation_matrix(pairs: DataFrame, features: list[str]) -> DataFrame:
    """A labelled square matrix, one row a feature, from pairs of each two; the diagonal is 1."""
    both = pairs.select("feature_1", "feature_2", "r").union(pairs.select("feature_2", "feature_1", "r"))
    own = pairs.sparkSession.createDataFrame([(f, f, 1.0) for f in features], "feature_1 string, feature_2 string, r double")
    return both.union(own).groupBy(F.col("feature_1").alias("feature")).pivot("feature_2", features).agg(F.first("r"))


def bundle_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """What the console shows of a bundle: one row of counts for each scope."""
    flags = lambda t, c, n: tables[t].groupBy("scope").agg(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(n))
    out = tables["ranking"].groupBy("scope").agg(F.count(F.lit(1)).alias("n_features"))
    for t, c, n in (("missingness", "flag_high_missing", "n_high_missing"), ("distributions", "flag_near_zero_variance", "n_near_zero_variance"), ("redundancy", "flag", "n_redundant"), ("confounds", "confounded", "n_confounded")):
        out = out.join(flags(t, c, n), "scope", "left").fillna(0, [n])
    return out
