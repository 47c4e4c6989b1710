"""Configured, resumable stages on one session: `python -m motionloom.plans.stages --config study.yaml`."""

from __future__ import annotations

import argparse
import json
import os
import time
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.functions import scalars as S
from motionloom.operators import evaluate, joins, learn, pca, stats, windows
from motionloom.operators import features as FE
from motionloom.sources import frames

# Stages in their order, sections a configuration needs, conditions and instruments of a study, the
# joint angles that every block of the shared components must have, the channels of the recurrent models, families
# of signals by the beginnings of their names, features taken from block tables, and prefixes of standardized ones.
ORDER = ["preprocess", "unified_pca", "extract_features", "merge_skill_labels", "analyze_features", "train_classical", "train_grouped", "train_rnn"]
SECTIONS = ["paths", "preprocessing", "feature_extraction", "cross_validation", "rnn"]
KEY = ["participant_id", "condition", "block"]
CONDITIONS = ["play", "mime"]
JOINTS = {"lower_body": ["LHip", "RHip", "LKnee", "RKnee", "LAnkle", "RAnkle"], "trunk_head": ["Spine1", "Spine2", "Spine3", "Neck", "Head"], "upper_body": ["LShoulder", "RShoulder", "LClavicle", "RClavicle", "LElbow", "RElbow", "LWrist", "RWrist"]}
ONE_AXIS = {"LElbow": "Y", "RElbow": "Y"}
SIDES, PARTS = ("R", "L"), ("Wrist", "Elbow", "Shoulder")
TASKS, MODES, SIZES = ("3class", "2class"), ("pooled", "separate"), ("baseline", "shared_pca")
CLASSES = {"3class": ["novice", "advanced_beginner", "expert"], "2class": ["novice", "expert"]}
MODELS = {"logreg": "logistic", "linear_svm": "svm", "random_forest": "forest"}
PROTOCOLS = ("trial", "participant")
BLOCK_FEATURES = ["PCA16_lower_body_mean_sd", "PCA16_trunk_head_mean_sd", "PCA16_upper_body_mean_sd", "PCA12a_PM1_rms", "PCA12a_PM2_rms", "PCA12a_PM7_rms"]
OWN_BLOCK_FEATURES = {"clarinet": ["PCA12a_PM4_rms"], "violin": ["PCA12a_PM6_rms"]}
STANDARDIZED = ("ROM_", "SPARC_", "LDJ_", "PCA_", "CRP_")
BASELINE = ["PCA_n_components_90", "PCA_total_variance_explained_by_pc1"]
RELATED = ["SPARC", "SPARC_RWrist", "SPARC_LWrist", *(f"{f}_stroke_{k}_{h}" for f in ("SPARC", "LDJ") for h in ("RWrist", "LWrist") for k in ("mean", "sd"))]
CANDIDATES = ["PCA11b_within_participant_consistency", "PCA11b_consistency_sd_pairs", *BLOCK_FEATURES[:3], *BASELINE, *(f"PCA12a_PM{i}_rms" for i in range(1, 8))]

CURATED = [f"{j}Angles_{x} (deg)" for joints_ in JOINTS.values() for j in joints_ for x in ONE_AXIS.get(j, "XYZ")]
CHANNELS = [f"{s}{p}Positions_{x} (mm)" for s in SIDES for p in PARTS for x in "XYZ"]
LOG = "n_rows long, nan_before long, nan_after long, skipped_nan long, skipped_short long, cutoffs array<double>, error string"


def load_config(path: str) -> dict:
    """A YAML or JSON configuration; relative paths are meant from its folder."""
    with open(path) as f:
        if path.endswith(".json"):
            cfg = json.load(f)
        else:
            import yaml

            cfg = yaml.safe_load(f)
    lack = [s for s in SECTIONS if s not in (cfg or {})]
    if lack:
        raise ValueError(f"config lacks sections {lack}")
    base = os.path.dirname(os.path.abspath(path))
    cfg["paths"] = {k: v if "://" in v or os.path.isabs(v) else os.path.join(base, v) for k, v in cfg["paths"].items()}
    return cfg


def wanted_conditions(value) -> list[str] | None:
    """Names from a list or a comma-separated text; None, for no filter, if it is `all`."""
    names = [x.strip().lower() for x in (value.split(",") if isinstance(value, str) else value) if x.strip()]
    return None if names == ["all"] else names


def of_conditions(df: DataFrame, value) -> DataFrame:
    names = wanted_conditions(value)
    return df if names is None else df.where(F.col("condition").isin(names))


def grid(tasks=TASKS, modes=MODES, configs=SIZES) -> list[tuple[str, str, str]]:
    return list(product(tasks, modes, configs))


def _participants(spark: SparkSession, cfg: dict) -> DataFrame:
    path = cfg["paths"].get("metadata_file")
    return frames.tolerant_metadata(frames.load_table(spark, path) if path and frames.exists(spark, path) else None, spark)


def _put(df: DataFrame, cfg: dict, folder: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a table below one of the configured folders and read it again."""
    path = f"{cfg['paths'][folder]}/{name}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    if cfg.get("csv") and not by:
        frames.write_report(df.sparkSession.read.parquet(path), path + "_export", as_csv=True)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not by else df.sparkSession.read.parquet(path)


def _clean_frames(spark: SparkSession, cfg: dict) -> DataFrame:
    return spark.read.parquet(f"{cfg['paths']['preprocessed_dir']}/trials").where("kind = 'frames'").drop("kind", "_log")


def warnings(signals: list[str], columns: list[str]) -> Column:
    """Messages of a trial's log row: what was dropped, missing, unusual or skipped."""
    say = lambda when, *text: F.when(when, F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)))
    short = F.col("log.skipped_short")
    return F.array_compact(
        F.array(
            say(F.col("had_annotations"), "dropped_annotations_column"),
            say(F.col("n_placeholders") > 0, "dropped_placeholder_cols:", F.col("n_placeholders")),
            say(F.col("n_empty") > 0, "dropped_empty_cols:", F.col("n_empty")),
            say(F.col("n_columns") != frames.WIDTH, "column_count_mismatch:", F.col("n_columns"), f"_vs_{frames.WIDTH}"),
            say(~F.col("timed"), "missing_time_s_column"),
            say(F.col("log.nan_after") > 0, "remaining_nans_after_interp:", F.col("log.nan_after")),
            say(F.col("log.skipped_nan") > 0, "skipped_filter_cols_has_nan:", F.col("log.skipped_nan")),
            say(short > 0, "filtering_skipped_trial_too_short:", short, "_cols"),
        )
    )


def preprocess(spark: SparkSession, cfg: dict, only: str | None = None) -> DataFrame:
    """Clean, gap-filled and filtered frames of every trial, and a log row a trial, in one job.

    `only` is a single file instead of the raw folder.
    """
    p, pre = cfg["paths"], cfg["preprocessing"]
    frames.require_other_folder(p["raw_mocap_dir"], p["preprocessed_dir"])
    read = frames.read_trials(spark, only or p["raw_mocap_dir"])
    if read is None:
        raise ValueError("no trial files")
    trials, rejects = frames.trial_keys(read)
    _put(rejects, cfg, "preprocessed_dir", "rejected_files")
    trials = of_conditions(trials, CONDITIONS)
    if "time_s" not in trials.columns:
        trials = trials.withColumn("time_s", F.lit(None).cast("double"))
    signals = frames.signal_columns(trials)
    table, default = frames.cutoff_map(pre.get("cutoff_map") or pre.get("joint_group_cutoffs")), float(pre.get("default_cutoff_hz", frames.DEFAULT_CUTOFF))
    # rows without times keep the order of their file
    indexed = windows.indexed(trials.withColumn("_at", F.monotonically_increasing_id()), KEY, [F.col("time_s").asc_nulls_last(), "_at"], "i").drop("_at")
    out = FE.cleaned(indexed, KEY, "i", {s: frames.cutoff(s, table, default) for s in signals}, int(pre.get("gap_limit_frames", 5)), float(pre.get("sampling_rate_hz", frames.RATE)))
    out = _put(out.withColumn("kind", F.when(F.col("_log").isNull(), "frames").otherwise("log")), cfg, "preprocessed_dir", "trials", ["kind", "condition"])
    columns = [x for x in trials.columns if x not in (*KEY, "path", "had_annotations", "n_placeholders")]
    seen = trials.groupBy(*KEY).agg(F.first("path").alias("path"), F.first("had_annotations").alias("had_annotations"), F.first("n_placeholders").alias("n_placeholders"), (F.count("time_s") > 0).alias("timed"), sum((F.when(F.count(S.c(x)) > 0, 1).otherwise(0) for x in columns), F.lit(0)).alias("n_columns"))
    seen = seen.withColumn("n_empty", F.lit(len(columns)) - F.col("n_columns"))
    logs = out.where("kind = 'log'").select(*KEY, F.from_json("_log", LOG).alias("log"))
    done = seen.join(logs, KEY).withColumn("warnings", warnings(signals, columns))
    status = F.when(F.col("log.error").isNotNull(), "error").otherwise(S.warning_status(F.col("warnings")))
    text = F.format_string("[%s]", F.array_join(F.transform(F.array_sort(F.array_distinct("log.cutoffs")), lambda x: x.cast("string")), ", "))
    log = done.select(F.element_at(F.split("path", "/"), -1).alias("file"), *KEY, "log.n_rows", "n_columns", F.col("log.nan_before").alias("nan_before_interp"), F.col("log.nan_after").alias("nan_after_interp"), "warnings", (F.size("log.cutoffs") > 0).alias("filtered"), text.alias("cutoff_hz_range_used"), status.alias("status"), F.col("log.error").alias("error"))
    return _put(log, cfg, "preprocessed_dir", "preprocessing_summary")


def collect_blocks(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """Frames with the vector of curated angles, of the wanted conditions and instruments, and skipped blocks with the reason."""

    df = of_conditions(_clean_frames(spark, cfg), cfg.get("unified_pca", {}).get("conditions", ["play"]))
    lack = [x for x in CURATED if x not in df.columns]
    people = _participants(spark, cfg).where(F.col("instrument").isin(*S.INSTRUMENTS))
    df = joins.lookup(df, people, "participant_id", "inner")
    vector = F.array(*(S.c(x) if x not in lack else F.lit(None).cast("double") for x in CURATED))
    spans = df.groupBy(*KEY).agg(stats.duration("time_s").alias("duration_s"), F.size(F.array_compact(F.array(*(F.when(F.count(S.c(x)) == 0, F.lit(x)) for x in CURATED if x not in lack)))).alias("_lost"))
    vec = df.select(*KEY, "instrument", F.col("skill").alias("skill_level"), "i", vector.alias("v"))
    good = pca.finite_rows(vec, KEY, "v")
    blocks = good.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_frames"))
    reason = F.when(F.col("_lost") + len(lack) > 0, F.concat(F.lit("missing "), (F.col("_lost") + len(lack)).cast("string"), F.lit(" curated columns"))).otherwise("fewer than 10 valid frames")
    skipped = spans.join(blocks, KEY, "left_anti").select(*KEY, reason.alias("reason"))
    return good.join(spans.drop("_lost").join(blocks, KEY), KEY), skipped


def unified_pca(spark: SparkSession, cfg: dict) -> DataFrame:
    """Consistency of blocks, shared components and variability, by block and participant, and their evaluation."""
    put = lambda df, name: _put(df, cfg, "unified_pca_eval_dir", name)
    blocks, skipped = collect_blocks(spark, cfg)
    put(skipped, "skipped_blocks")
    info = ["instrument", "skill_level", "duration_s", "n_frames"]
    blocks = put(blocks, "blocks")
    if blocks.isEmpty():
        raise ValueError("no valid blocks: check paths, metadata and conditions")
    about = blocks.select(*KEY, *info).distinct()

    person = ["participant_id", "instrument", "condition", "skill_level"]
    loads = pca.block_loadings(blocks, KEY, "i", "v").join(about, KEY)
    consistency = pca.consistency(pca.aligned(loads, person, "block"), person, "block")
    spans = loads.groupBy(*person).agg(F.avg("duration_s").alias("mean_duration_s"))
    consistency = consistency.join(spans, person).where("n_blocks >= 2").select(*person, "n_blocks", "mean_duration_s", F.col("consistency").alias("PCA11b_within_participant_consistency"), F.col("consistency_sd").alias("PCA11b_consistency_sd_pairs"))
    consistency = put(consistency, "coordination_consistency_participant")

    long = put(pca.normalized(blocks, KEY, "i", "v"), "normalized")
    share, axes = pca.shared_components(pca.covariance(long, KEY, "i", len(CURATED)), None, len(CURATED))
    put(pca.loadings(spark, share, axes), "shared_pm_loadings_all")
    names = [f"PCA12a_PM{k}_rms" for k in range(1, 26)]
    wide = pca.usage(long, KEY, "i", axes).groupBy(*KEY).pivot("pm", list(range(1, 26))).agg(F.first("rms"))
    usage = put(wide.select(*KEY, *(F.col(str(k + 1)).alias(n) for k, n in enumerate(names))).join(about, KEY), "shared_pm_usage_by_block")
    put(pca.summary(spark, share, len(CURATED), usage.count()), "shared_pm_summary")

    signal = F.element_at(F.array(*map(F.lit, CURATED)), F.col("signal") + 1)
    sds = pca.temporal_sd(pca.signals_long(blocks, KEY, "v"), KEY).withColumn("name", signal)
    family = S.family(F.col("name"), {k: tuple(v) for k, v in JOINTS.items()})
    put(sds.select(*KEY, F.col("name").alias("signal"), family.alias("family"), F.col("temporal_sd").alias("PCA16_temporal_sd_deg")).join(about, KEY), "joint_angle_variability_by_block")
    spread = pca.family_means(sds, KEY, family, list(JOINTS))
    spread = put(spread.select(*KEY, *(F.col(f"{f}_mean_sd").alias(f"PCA16_{f}_mean_sd") for f in JOINTS)).join(about, KEY), "joint_angle_variability_family_by_block")

    means = lambda df, feats: stats.participant_means(df.withColumn("mean_duration_s", F.col("duration_s")), person, [*feats, "mean_duration_s"], "block")
    usage_p = put(means(usage, names), "shared_pm_usage_participant")
    spread_p = put(means(spread, BLOCK_FEATURES[:3]), "joint_angle_variability_family_participant")
    tables = [("", consistency), ("_pm", usage_p), ("_var", spread_p)]
    trials = f"{cfg['paths']['features_dir']}/trial_features"
    if frames.exists(spark, trials):  # of an earlier run
        base = baseline_participants(spark.read.parquet(trials), cfg)
        tables.append(("_baseline", put(base, "baseline_participant")))
    master = joins.outer_chain(tables, person)
    spans = [x for x in master.columns if x.startswith("mean_duration_s")]
    master = put(master.withColumn("mean_duration_s", F.coalesce(*spans)), "unified_pca_participant_features")

    found = [x for x in CANDIDATES if x in master.columns]
    long = stats.long_form(master, ["instrument", "skill_level", "mean_duration_s"], found)
    put(evaluate.skill_duration_tails(evaluate.skill_duration(long, ["instrument"], "skill_level", "mean_duration_s")), "skill_duration_evaluation")
    pairs = stats.with_tails(evaluate.redundancy_by(master, "instrument", [*found, *(x for x in RELATED if x in master.columns)]).withColumnRenamed("n_participants", "n")).withColumnRenamed("n", "n_participants")
    return put(pairs.orderBy(F.abs("r").desc(), "feature_1", "feature_2"), "redundancy_correlations")


def baseline_participants(trials: DataFrame, cfg: dict) -> DataFrame:
    """Participants' means of the trial features that the components are compared with."""
    if "status" in trials.columns:
        trials = trials.where("status = 'ok'")
    df = of_conditions(trials, cfg.get("unified_pca", {}).get("conditions", ["play"]))
    skill = S.canonical_label(S.c("Skill Level")) if "Skill Level" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"skill_level": skill, "mean_duration_s": F.col("trial_duration_seconds")})
    have = [x for x in [*BASELINE, *RELATED] if x in df.columns]
    return stats.participant_means(df, ["participant_id", "instrument", "condition", "skill_level"], [*have, "mean_duration_s"], "block")


def trial_rows(df: DataFrame, people: DataFrame) -> DataFrame:
    """One row a trial: instrument, duration, ranges of motion, smoothness and strokes, status and error."""
    kinds = joins.lookup(df, people.select("participant_id", S.instrument(F.col("instrument")).alias("instrument")), "participant_id").withColumn("instrument", F.coalesce("instrument", F.lit("default")))
    angles = [f"{j}_{x}" for j in FE.JOINTS for x in FE.AXES if f"{j}_{x} (deg)" in df.columns]
    named = kinds.select(*KEY, "instrument", "time_s", *(S.number(S.c(f"{a} (deg)")).alias(a) for a in angles))
    rom = stats.range_of_motion(named, [*KEY, "instrument"], "time_s", angles).withColumnRenamed("duration", "trial_duration_seconds")
    moves = FE.movement(kinds, KEY, "time_s", "instrument")
    good = rom.join(moves.where("status = 'ok'"), KEY)
    # failed trials stay in the table, with nothing but their status
    return good.unionByName(moves.where("status <> 'ok'").select(*KEY, "status", "error"), allowMissingColumns=True)


def standardized(df: DataFrame) -> DataFrame:
    """Each feature's z within its instrument, beside it."""
    names = [x for x, kind in df.dtypes if x.startswith(STANDARDIZED) and not x.endswith("_z") and kind in ("double", "float", "int", "bigint")]
    return df.select("*", *(windows.zscore(F.col(x), ["instrument"]).alias(f"{x}_z") for x in names))


def extract(spark: SparkSession, cfg: dict) -> DataFrame:
    """Trial features with block features joined on and z columns, the unmatched rows, and CVs across trials."""
    fe = cfg["feature_extraction"]
    rows = _put(trial_rows(of_conditions(_clean_frames(spark, cfg), fe.get("conditions", CONDITIONS)), _participants(spark, cfg)), cfg, "features_dir", "trial_rows")
    good, failed = rows.where("status = 'ok'"), rows.where("status <> 'ok'").select(*KEY, "status", "error")
    base, own = cfg["paths"]["unified_pca_eval_dir"], bool(fe.get("include_instrument_specific_pca"))
    tables = {n: spark.read.parquet(f"{base}/{n}") for n in ("shared_pm_usage_by_block", "joint_angle_variability_family_by_block") if frames.exists(spark, f"{base}/{n}")}
    if tables:
        wanted = [*BLOCK_FEATURES, *(x for v in OWN_BLOCK_FEATURES.values() for x in v if own)]
        good, lost = joins.merged_block_features(good, tables, wanted)
        _put(lost, cfg, "features_dir", "unmatched_pca_rows")
        good = joins.only_within(good, "instrument", OWN_BLOCK_FEATURES) if own else good
    if fe.get("normalize", True):
        good = standardized(good)
    out = _put(good.unionByName(failed, allowMissingColumns=True), cfg, "features_dir", "trial_features")
    measured = [x for x in out.columns if x.startswith(STANDARDIZED)]
    cv = stats.across_trial_cv(out.where("status = 'ok'"), ["participant_id", "condition", "instrument"], measured)
    _put(cv, cfg, "features_dir", "cv_features")
    return out


def merge(spark: SparkSession, cfg: dict) -> DataFrame:
    """Trial features with the participants' metadata, and the participants that only one side has."""
    trials = spark.read.parquet(f"{cfg['paths']['features_dir']}/trial_features").withColumn("participant_id", S.participant(F.col("participant_id")))
    meta = frames.metadata(frames.load_table(spark, cfg["paths"]["metadata_file"]))
    _put(joins.unmatched(trials, meta, ["participant_id"]), cfg, "features_dir", "unmatched_participants")
    # `Instrument` of the metadata stands beside the trials' own `instrument`: names differ in case only
    meta = meta.withColumnRenamed("Instrument", "Instrument_meta")
    return _put(joins.many_to_one(trials, meta, ["participant_id"], matched="has_metadata"), cfg, "features_dir", "trial_features_with_skill")


def analyze(spark: SparkSession, cfg: dict) -> DataFrame:
    """The report bundle, overall and by instrument, one folder a table."""
    opts = cfg.get("diagnostics", {})
    df = spark.read.parquet(f"{cfg['paths']['features_dir']}/trial_features_with_skill").where("status = 'ok'")
    feats = [x for x in evaluate.diagnostic_features(df, opts.get("feature_set", "raw_only")) if x not in KEY]
    target = S.find_column(df.columns, opts.get("target_col", "Skill Level"))
    df = df.select(*KEY, "instrument", S.c(target).cast("string").alias("_label"), *(S.c(x) for x in feats)).persist()
    tables = evaluate.bundle(df, KEY, feats, "_label", "instrument", list(S.INSTRUMENTS), opts.get("per_instrument", True))
    tables["feature_correlations"] = evaluate.correlation_matrix(tables["correlations"].where("scope = 'overall'"), feats)
    for name, t in tables.items():
        _put(t, cfg, "analysis_dir", name)
    out = _put(evaluate.bundle_summary({n: spark.read.parquet(f"{cfg['paths']['analysis_dir']}/{n}") for n in tables}), cfg, "analysis_dir", "summary")
    df.unpersist()
    return out


def experiment(df: DataFrame, features: list[str], task: str, model: str, splits: int, grouped: bool, k_best: int = 0, **how) -> tuple[DataFrame, int]:
    """Predictions of one model over all folds, with training rows, and the number of folds."""
    names = CLASSES[task]
    d = df.withColumns({"y": (F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1).cast("int"), "row": F.pmod(F.xxhash64(*KEY), F.lit(learn.PRIME)), "g": F.pmod(F.xxhash64("participant_id"), F.lit(learn.PRIME))})
    k = learn.clipped_splits(d, "y", splits, "participant_id" if grouped else None)
    d = learn.grouped_folds(d, "g", "y", k) if grouped else learn.stratified_folds(d, "row", "y", k)
    d = d.select(*KEY, "instrument", "y", "fold", "g", *(S.number(S.c(x)).alias(x) for x in features))
    p = learn.cross_validated(d, features, "y", MODELS[model], list(range(k)), "g" if grouped else None, k_best or None, with_train=True, **how)
    return p.drop("g"), k


def train(spark: SparkSession, cfg: dict, grouped: bool) -> DataFrame:
    """All tasks, modes, feature configurations and models: fold metrics, predictions, selected features, confusion, settings, summary."""
    cv, opts = cfg["cross_validation"], cfg.get("classical_models", {})
    folder = "training_results_grouped_dir" if grouped else "training_results_dir"
    df = spark.read.parquet(f"{cfg['paths']['features_dir']}/trial_features_with_skill")
    target, splits, k_best = cfg.get("diagnostics", {}).get("target_col", "Skill Level"), int(cv.get("n_splits", 5)), int(opts.get("k_best", 0) or 0)
    forest = {"trees": 500, "depth": 30, "leaf": 2} if grouped else {"trees": 500, "depth": 8, "leaf": 5}
    forest["trees"] = int(opts.get("n_estimators", forest["trees"]))
    how = {"logreg": {"c": 1.0 if grouped else 0.5}, "linear_svm": {"c": 1.0 if grouped else 0.1}, "random_forest": forest}
    models = opts.get("models") or list(MODELS)
    predicted, settings = None, []
    for task, mode, config in grid(opts.get("tasks") or TASKS, opts.get("modes") or MODES, opts.get("configs") or SIZES):
        rows = evaluate.model_rows(df, target, task, one_label=grouped)
        for instrument in [None] if mode == "pooled" else S.INSTRUMENTS:
            # a pooled model never reads features of one instrument: their absence would tell it
            used = "shared_pca" if mode == "pooled" and config in evaluate.SEPARATE else config
            own = rows if instrument is None else rows.where(F.col("instrument") == instrument)
            feats = evaluate.model_features(own, used, instrument)
            feats = evaluate.supported_features(own, feats, "instrument")
            name = f"{instrument or 'pooled'}_{used}" + ("_grouped" if grouped else "")
            if not feats or own.isEmpty():
                settings.append({"task": task, "run_name": name, "skipped": "no usable features" if not feats else "no trials"})
                continue
            for model in models:
                p, k = experiment(own, feats, task, model, splits, grouped, k_best, **how[model])
                p = p.withColumns({"task": F.lit(task), "run_name": F.lit(name), "model": F.lit(model), "n_splits": F.lit(k), "n_features_input": F.lit(len(feats))})
                predicted = p if predicted is None else predicted.unionByName(p)
                settings.append({"task": task, "run_name": name, "model": model, "protocol": "participant-grouped" if grouped else "trial-wise", "class_order": CLASSES[task], "feature_columns_input": feats, "n_splits": k, "k_best": k_best, **how[model]})
    if predicted is None:
        raise ValueError("no model could be trained")
    return write_training(spark, predicted, settings, cfg, folder)


def write_training(spark: SparkSession, predicted: DataFrame, settings: list[dict], cfg: dict, folder: str) -> DataFrame:
    """All result tables of a training stage from its predictions."""
    run = ["task", "run_name", "model"]
    predicted = _put(predicted, cfg, folder, "predictions")
    scores = None
    for task, names in CLASSES.items():
        own = predicted.where(F.col("task") == task)
        t = learn.fold_table(own, "y", list(range(len(names))), names, run)
        scores = t if scores is None else scores.unionByName(t, allowMissingColumns=True)
    per = predicted.groupBy(*run, "fold").agg(F.max("n_features_input").alias("n_features_before_correlation_pruning"), (F.max("n_features_input") - F.max("n_pruned")).alias("n_features_after_correlation_pruning"), F.max(F.size(F.split("features", ";"))).alias("n_features_final"), F.max("n_pruned").alias("n_correlated_features_removed"))
    scores = _put(scores.join(per, [*run, "fold"]), cfg, folder, "fold_metrics")
    chosen = predicted.select(*run, "fold", "features", "n_splits").distinct()
    per_split = chosen.groupBy(*run).agg(F.max("n_splits").alias("n"))
    often = learn.selection_frequency(chosen, 1, run).join(per_split, run).withColumn("selection_frequency", F.col("n_folds_selected") / F.col("n")).drop("n")
    _put(often.orderBy(*run, F.desc("selection_frequency"), "feature"), cfg, folder, "selected_feature_frequency")
    matrix = stats.confusion(predicted.where("part = 'test'").withColumn("prediction", F.col("prediction").cast("int")), "y", "prediction", [0, 1, 2], run)
    wide = matrix.groupBy(*run, "y").pivot("prediction", [0, 1, 2]).agg(F.sum("n"))
    _put(wide.select(*run, "y", *(F.col(str(k)).alias(f"predicted_{k}") for k in range(3))), cfg, folder, "confusion_matrix_total")
    frames.write_json(spark.createDataFrame([(json.dumps(x),) for x in settings], "settings string"), f"{cfg['paths'][folder]}/experiment_settings")
    test = predicted.where("part = 'test'")
    sizes = test.groupBy(*run, "y").agg(F.count(F.lit(1)).alias("n")).groupBy(*run).agg(F.sum("n").alias("n_trials"), S.counts_json(F.col("y").cast("string"), F.col("n")).alias("class_counts"))
    people = test.groupBy(*run).agg(F.count_distinct("participant_id").alias("n_participants"), F.max("n_features_input").alias("n_features_input"), F.max("n_splits").alias("n_splits"))
    summary = learn.fold_summary(scores, ["balanced_accuracy", "macro_f1", "weighted_f1", "train_test_gap"], run).join(sizes, run).join(people, run)
    return _put(summary.orderBy("task", "run_name", F.desc("balanced_accuracy_mean"), "model"), cfg, folder, "experiment_summary")


def collect_sequences(spark: SparkSession, cfg: dict, task: str) -> DataFrame:
    """(trial, participant_id, label, y, seq) of the trials a recurrent model reads; none is an error."""
    opts = cfg["rnn"]
    df = of_conditions(_clean_frames(spark, cfg), opts.get("conditions", CONDITIONS))
    people = _participants(spark, cfg)
    if opts.get("instrument", "all") != "all":
        people = people.where(F.col("instrument") == opts["instrument"])
    people = people.withColumn("label", S.task_label(F.col("skill"), task)).where("label is not null")
    df = joins.lookup(df, people, "participant_id", "inner")
    channels = [x for x in opts.get("position_columns", CHANNELS) if x in df.columns]
    named = df.select(*KEY, "label", "i", *(S.c(x).alias(f"x{k}") for k, x in enumerate(channels)))
    if len(channels) < 3:
        raise ValueError("too few channels")
    seqs = learn.sequences(named, [*KEY, "label"], "i", [f"x{k}" for k in range(len(channels))])
    names = CLASSES[task]
    seqs = seqs.withColumns({"y": (F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1).cast("int"), "trial": F.concat_ws("_", *KEY), "row": F.pmod(F.xxhash64(*KEY), F.lit(learn.PRIME)), "g": F.pmod(F.xxhash64("participant_id"), F.lit(learn.PRIME))})
    if seqs.isEmpty():
        raise ValueError("no usable trials: check metadata, instrument and task")
    return seqs


def train_rnn(spark: SparkSession, cfg: dict) -> DataFrame:
    """Recurrent models of all tasks and protocols: fold metrics, predictions, confusion, summary."""
    opts, splits, kind = cfg["rnn"], int(cfg["cross_validation"].get("n_splits", 5)), cfg["rnn"].get("rnn_type", "gru")
    how = {"hidden": int(opts.get("hidden_dim", 64)), "layers": int(opts.get("num_layers", 2)), "dropout": float(opts.get("dropout", 0.3)), "epochs": int(opts.get("epochs", 60)), "patience": int(opts.get("patience", 8)), "batch": int(opts.get("batch_size", 16)), "rate": float(opts.get("learning_rate", 1e-3)), "decay": float(opts.get("weight_decay", 1e-4))}
    out = None
    for task, protocol in product(opts.get("tasks") or TASKS, opts.get("protocols") or PROTOCOLS):
        seqs, grouped = collect_sequences(spark, cfg, task), protocol == "participant"
        k = learn.clipped_splits(seqs, "y", splits, "participant_id" if grouped else None)
        d = learn.grouped_folds(seqs, "g", "y", k) if grouped else learn.stratified_folds(seqs, "row", "y", k)
        p = learn.recurrent_cv(d.select("trial", "y", "fold", "g", "seq"), "trial", "y", "g" if grouped else None, kind, **how)
        p = p.withColumns({"task": F.lit(task), "protocol": F.lit(protocol), "rnn_type": F.lit(kind)})
        out = p if out is None else out.unionByName(p)
    run, folder = ["task", "protocol", "rnn_type"], "training_results_rnn_dir"
    out = _put(out, cfg, folder, "predictions")
    scores = None
    for task, names in CLASSES.items():
        own = out.where(F.col("task") == task)
        t = learn.fold_table(own, "y", list(range(len(names))), names, run)
        held = learn.fold_table(own.withColumn("part", F.when(F.col("part") == "val", "test").when(F.col("part") == "test", "val").otherwise(F.col("part"))), "y", list(range(len(names))), names, run)
        t = t.join(held.select(*run, "fold", F.col("balanced_accuracy").alias("val_balanced_accuracy"), F.col("n_test").alias("n_val")), [*run, "fold"])
        scores = t if scores is None else scores.unionByName(t, allowMissingColumns=True)
    scores = _put(scores.withColumnRenamed("balanced_accuracy", "test_balanced_accuracy").withColumnRenamed("macro_f1", "test_macro_f1"), cfg, folder, "fold_metrics")
    tested = out.where("part = 'test'").withColumn("prediction", F.col("prediction").cast("int"))
    _put(stats.confusion(tested, "y", "prediction", [0, 1, 2], [*run, "fold"]), cfg, folder, "confusion_matrix_folds")
    summary = learn.fold_summary(scores, ["test_balanced_accuracy", "train_test_gap"], run)
    frames.write_json(summary, f"{cfg['paths'][folder]}/experiment_summary_json")
    return _put(summary, cfg, folder, "experiment_summary")


RUN = {"preprocess": preprocess, "unified_pca": unified_pca, "extract_features": extract, "merge_skill_labels": merge, "analyze_features": analyze, "train_classical": lambda s, c: train(s, c, False), "train_grouped": lambda s, c: train(s, c, True), "train_rnn": train_rnn}


def run(spark: SparkSession, cfg: dict, only: list[str] | None = None, skip_rnn: bool = False, dry: bool = False) -> list[str]:
    """Stages in their fixed order; the first failure ends the run and names the stages to resume with."""
    bad = [s for s in only or [] if s not in ORDER]
    if bad:
        raise ValueError(f"no such stages: {bad}; there are {ORDER}")
    todo = [s for s in ORDER if (not only or s in only) and not (skip_rnn and s == "train_rnn" and not only)]
    for s in todo:
        if dry:
            continue
        start = time.time()
        try:
            RUN[s](spark, cfg)
        except Exception as e:
            raise RuntimeError(f"stage {s} failed: {e}\nresume with --only {','.join(ORDER[ORDER.index(s):])}") from e
        print(f"[ok] {s} in {time.time() - start:.1f} s")
    return todo


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Movement study: from raw trials to trained models.")
    a.add_argument("--config", required=True)
    a.add_argument("--only", help="comma-separated stages")
    a.add_argument("--skip-rnn", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--single-file", help="clean this one trial file instead of the raw folder")
    a.add_argument("--csv", action="store_true", help="write each report as CSV too")
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("motionloom").getOrCreate()
    cfg = load_config(o.config) | ({"csv": True} if o.csv else {})
    if o.single_file:
        preprocess(spark, cfg, o.single_file).show(truncate=False)
        return
    only = [s.strip() for s in o.only.split(",") if s.strip()] if o.only else None
    print("\n".join(run(spark, cfg, only, o.skip_rnn, o.dry_run)))
    if not o.dry_run and (not only or "analyze_features" in only):
        spark.read.parquet(f"{cfg['paths']['analysis_dir']}/summary").show(truncate=False)
        spark.read.parquet(f"{cfg['paths']['analysis_dir']}/ranking").where("scope = 'overall'").orderBy("rank").show(10, truncate=False)


if __name__ == "__main__":
    main()
