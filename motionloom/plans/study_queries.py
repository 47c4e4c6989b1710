"""Registered queries of a study's stages: trials at 50 a second, filters, block features, folds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionloom.functions import scalars as S
from motionloom.operators import evaluate
from motionloom.operators import features as FE
from motionloom.operators import joins, learn, pca, stats
from motionloom.operators import windows as W
from motionloom.plans import stages
from motionloom.plans.catalog import ANOVA, FRAMES, META, OL, ROM, SIGNALS, _frames, _labelled, _meta, _r, _read, _rom, _shared, query
from motionloom.sources import frames

STEADY = "s AS (SELECT user_id // 4 AS trial, value, row_number() OVER (PARTITION BY user_id // 4 ORDER BY time_s, event_id) - 1 AS i FROM e)"


def _steady(spark, d):
    """Trials of four users' events, one after another at 50 a second."""
    df = _frames(spark, d).withColumn("trial", F.floor(F.col("user_id") / 4).cast("long"))
    return W.indexed(df, ["trial"], ["time_s", "event_id"]).withColumn("t", F.col("i") / 50.0)


@query()
def butter_filtfilt(spark, d):
    return FE.filtered(_steady(spark, d).select("trial", "i", "value"), ["trial"], "i", {"value": 6.0})


@query()
def sparc_window(spark, d):
    return FE.smoothness(_steady(spark, d), ["trial"], "t", ["value"])


@query()
def stroke_ldj(spark, d):
    """Strokes of a point that moves by the values in millimetres."""
    return FE.stroke_jerk(_steady(spark, d), ["trial"], "t", ["value"], "clarinet")


# 27 of 132 frequencies at 50 a second are up to 10 Hz; values are positive, so the greatest amplitude is at 0 Hz
@query(
    f"WITH {FRAMES}, {STEADY}, n AS (SELECT trial, count(*) AS n FROM s GROUP BY 1), w AS (SELECT trial, unnest(range((n - 100) // 5 + 1)) AS k FROM n WHERE n >= 100),"
    " x AS (SELECT w.trial, k, i - 5 * k AS j, value FROM w JOIN s ON w.trial = s.trial AND i BETWEEN 5 * k AND 5 * k + 99), q AS (SELECT unnest(range(0, 27)) AS q),"
    " m AS (SELECT trial, k, q, sqrt(pow(sum(value * cos(2 * pi() * q * j / 132)), 2) + pow(sum(value * sin(2 * pi() * q * j / 132)), 2)) AS m FROM x, q GROUP BY ALL),"
    " r AS (SELECT trial, k, q, m / max(m) OVER (PARTITION BY trial, k) AS m FROM m), b AS (SELECT trial, k, min(q) AS a, max(q) AS z FROM r WHERE m >= 0.05 GROUP BY ALL),"
    " a AS (SELECT trial, k, -sum(sqrt(pow(1.0 / (z - a), 2) + pow(d, 2))) AS v FROM (SELECT *, m - lag(m) OVER (PARTITION BY trial, k ORDER BY q) AS d FROM r) JOIN b USING (trial, k) WHERE q > a AND q <= z GROUP BY trial, k)"
    " SELECT trial, round(median(v), 6) AS sparc, count(*)::INTEGER AS n_windows FROM a GROUP BY trial"
)
def sparc_of_speeds(spark, d):
    """The values taken as speeds: windows of 2 s every 0.1 s."""
    s = FE.window_smoothness(_steady(spark, d), ["trial"], "t", "value").where("n_windows > 0")
    return s.select("trial", _r("sparc").alias("sparc"), "n_windows")


@query(f"WITH {FRAMES}, {STEADY}, j AS (SELECT *, (lead(value) OVER w - 2 * value + lag(value) OVER w) * 2500 AS j FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)) SELECT trial, round(-ln(pow(count(*) / 50.0, 3) * sum(j * j) / 50.0 / pow(max(value), 2)), 6) AS ldj FROM j GROUP BY trial HAVING count(*) >= 4")
def jerk_of_speeds(spark, d):
    """Logarithmic dimensionless jerk of the values taken as speeds, a trial as one stroke."""
    return FE.whole_jerk(_steady(spark, d), ["trial"], "i", "value").where("ldj is not null").select("trial", _r("ldj").alias("ldj"))


@query()
def trial_movement(spark, d):
    """Smoothness and strokes by instrument: trials alternate between violin, clarinet and others."""
    df = _steady(spark, d).withColumn("instrument", F.element_at(F.array(F.lit("violin"), F.lit("clarinet"), F.lit("other")), (F.col("trial") % 3 + 1).cast("int")))
    points = {FE.POINT.format(h, x): F.col("value") * k for h in ("LWrist", "RWrist") for k, x in enumerate(FE.AXES, 1)}
    return FE.movement(df.withColumns(points | {"RElbowAngles_Y (deg)": F.col("value")}), ["trial"], "t", "instrument")


@query("SELECT o_orderkey, o_orderstatus, lower(trim(c_mktsegment)) AS kind FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND lower(o_orderpriority) IN ('1-urgent', '2-high') AND lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def study_filters(spark, d):
    """Rows of one status, of the wanted conditions, and of participants of the wanted instruments."""
    o = _read(spark, d, "orders").withColumn("condition", S.condition(F.col("o_orderpriority"))).where("o_orderstatus = 'F'")
    people = _read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), S.condition(F.col("c_mktsegment")).alias("kind")).where(F.col("kind").isin("building", "machinery"))
    return joins.lookup(stages.of_conditions(o, "1-URGENT, 2-high"), people, "o_custkey", "inner").select("o_orderkey", "o_orderstatus", "kind")


NAME = "'^([pP][0-9]+)_([a-zA-Z]+)_([0-9]+)'"


@query(
    "WITH k AS (SELECT o_orderkey, concat(CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE 'P' END, o_custkey, '_', o_orderstatus, 'lay_', o_orderkey % 9, '.csv') AS name FROM orders)"
    f" SELECT o_orderkey, upper(regexp_extract(name, {NAME}, 1)) AS participant_id, lower(regexp_extract(name, {NAME}, 2)) AS condition, TRY_CAST(regexp_extract(name, {NAME}, 3) AS INTEGER) AS block FROM k WHERE name LIKE 'P%'"
)
def trial_names(spark, d):
    """Keys from file names, with or without the mark of cleaned files; names that don't tell go to the rejects."""
    name = F.concat(F.when(F.col("o_custkey") % 7 == 0, "x").otherwise("P"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderstatus", F.lit("lay_"), (F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_clean").otherwise(""), F.lit(".csv"))
    o = _read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/data/"), name).alias("path"))
    return frames.trial_keys(o)[0].select("o_orderkey", "participant_id", "condition", "block")


def _block_tables(spark, d):
    li = _read(spark, d, "lineitem")
    keyed = li.select(F.col("l_suppkey").alias("participant_id"), F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("block"), "l_quantity", "l_tax")
    key = ["participant_id", "condition", "block"]
    trials = keyed.groupBy(*key).agg(F.count("*").alias("n_rows"))
    some = keyed.where("block <> 3").groupBy(*key).agg(_r(F.avg("l_quantity"), 7).alias("PCA12a_PM1_rms"), F.max("l_tax").alias("other"))
    more = keyed.where("block > 2").groupBy(*key).agg(_r(F.avg("l_tax"), 7).alias("PCA16_lower_body_mean_sd"))
    return trials, {"usage": some, "spread": more}


BLOCK_SQL = "t AS (SELECT l_suppkey::VARCHAR AS participant_id, lower(l_returnflag) AS condition, l_linenumber::INTEGER AS block, count(*) AS n_rows, round(avg(l_quantity), 7) AS q, round(avg(l_tax), 7) AS x FROM lineitem GROUP BY ALL)"
WANTED = ["PCA12a_PM1_rms", "PCA16_lower_body_mean_sd"]


@query(f'WITH {BLOCK_SQL} SELECT participant_id, condition, block, n_rows, CASE WHEN block <> 3 THEN q END AS "PCA12a_PM1_rms", CASE WHEN block > 2 THEN x END AS "PCA16_lower_body_mean_sd" FROM t')
def block_feature_merge(spark, d):
    return joins.merged_block_features(*_block_tables(spark, d), WANTED)[0]


@query(f"WITH {BLOCK_SQL} SELECT 'usage' AS \"table\", participant_id, condition, block FROM t WHERE block = 3 UNION ALL SELECT 'spread', participant_id, condition, block FROM t WHERE block <= 2")
def block_feature_unmatched(spark, d):
    return joins.merged_block_features(*_block_tables(spark, d), WANTED)[1]


@query("SELECT l_orderkey, l_linenumber, CASE WHEN lower(l_returnflag) = 'a' THEN l_tax END AS l_tax, CASE WHEN lower(l_returnflag) = 'r' THEN l_discount END AS l_discount FROM lineitem")
def own_group_columns(spark, d):
    return joins.only_within(_read(spark, d, "lineitem"), "l_returnflag", {"a": ["l_tax"], "r": ["l_discount"]}).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


def _z(x: str) -> str:
    return f"CASE WHEN count({x}) OVER w >= 2 AND stddev_pop({x}) OVER w > 0 THEN ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w END"


@query(f"WITH {FRAMES}, {ROM}, {META} SELECT r.user_id, round({_z('rom')}, 6) AS z_rom, round({_z('(rom / duration)')}, 5) AS z_rate FROM r LEFT JOIN m USING (user_id) WINDOW w AS (PARTITION BY instrument)")
def feature_z_columns(spark, d):
    z = stages.standardized(joins.many_to_one(_rom(spark, d), _meta(spark, d), ["user_id"]))
    return z.select("user_id", _r("ROM_value_z").alias("z_rom"), _r("ROM_rate_value_z", 5).alias("z_rate"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n >= 6 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'rush' WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 'rest' END AS family, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first FROM orders LEFT JOIN n ON l_orderkey = o_orderkey")
def row_messages(spark, d):
    """Status by messages, family by the beginning of a name, and a number where there is one."""
    n = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = _read(spark, d, "orders").join(n, "o_orderkey", "left")
    said = F.array_compact(F.array(F.when(F.col("n") >= 6, F.concat(F.lit("column_count_mismatch:"), F.col("n").cast("string"))), F.when(F.col("n") == 3, F.lit("dropped_empty_cols:1"))))
    return o.select("o_orderkey", S.warning_status(said).alias("status"), S.family(F.col("o_orderpriority"), {"rush": ("1",), "rest": ("4", "5")}).alias("family"), S.number(F.substring("o_orderpriority", 1, 1)).alias("first"))


@query("SELECT c_nationkey, '{' || string_agg('\"' || c_mktsegment || '\":' || n, ',' ORDER BY c_mktsegment) || '}' AS class_counts FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def class_count_json(spark, d):
    return _read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").count().groupBy("c_nationkey").agg(S.counts_json(F.col("c_mktsegment"), F.col("count")).alias("class_counts"))


@query("SELECT c_custkey::VARCHAR AS participant_id, lower(trim(c_mktsegment)) AS instrument, CASE c_custkey % 3 WHEN 0 THEN 'novice' WHEN 1 THEN 'expert' ELSE 'advanced_beginner' END AS skill FROM customer")
def tolerant_metadata(spark, d):
    """Participants from columns whose names only hold the words looked for."""
    skill = F.element_at(F.array(F.lit(" Beginner"), F.lit("Proficient-and Expert"), F.lit("advancedbeginner")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return frames.tolerant_metadata(_read(spark, d, "customer").select(F.col("c_custkey").alias(" ID"), F.col("c_mktsegment").alias("Main Instrument"), skill.alias("skill level (self)")), spark)


FOLDS = (
    "p AS (SELECT doc_id % 3 AS fold, doc_id // 6 % 2 AS y, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS part, CASE WHEN doc_id % 7 = 0 THEN 1 - doc_id // 6 % 2 ELSE doc_id // 6 % 2 END AS q FROM labels),"
    " c AS (SELECT fold, part, count(*) AS n, sum(CASE WHEN y = 1 AND q = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y = 0 AND q = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn, sum(y)::DOUBLE AS p, sum(q)::DOUBLE AS s FROM p GROUP BY ALL),"
    " m AS (SELECT fold, part, n, p, (tp / p + tn / (n - p)) / 2 AS ba, 2 * tp / (p + s) AS f1, 2 * tn / (2 * n - p - s) AS f0 FROM c)"
)


@query(f"WITH {FOLDS} SELECT t.fold::INTEGER AS fold, r.n AS n_train, t.n AS n_test, round(t.ba, 6) AS balanced_accuracy, round((t.f1 + t.f0) / 2, 6) AS macro_f1, round((t.f1 * t.p + t.f0 * (t.n - t.p)) / t.n, 6) AS weighted_f1, round(r.ba, 6) AS train_balanced_accuracy, round(r.ba - t.ba, 6) AS train_test_gap, round(t.f1, 6) AS f1_good FROM m t JOIN m r ON t.fold = r.fold AND t.part = 'test' AND r.part = 'train'")
def fold_metrics(spark, d):
    """Fold metrics with training scores and their gap, of predictions that are wrong for every seventh row."""
    y = (F.floor(F.col("doc_id") / 6) % 2).cast("int")
    said = F.when(F.col("doc_id") % 7 == 0, 1 - y).otherwise(y)
    p = _read(spark, d, "labels").select((F.col("doc_id") % 3).cast("int").alias("fold"), y.alias("quality"), said.alias("prediction"), F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train").alias("part"))
    t = learn.fold_table(p, "quality", [0, 1], ["bad", "good"])
    return t.select("fold", "n_train", "n_test", *(_r(x).alias(x) for x in ("balanced_accuracy", "macro_f1", "weighted_f1", "train_balanced_accuracy", "train_test_gap", "f1_good")))


@query("SELECT feature, count(*) AS n_folds_selected, round(count(*) / 5.0, 6) AS selection_frequency FROM (SELECT DISTINCT o_custkey % 5 AS fold, unnest([o_orderstatus, lower(o_orderpriority)]) AS feature FROM orders WHERE o_custkey % 11 < 4) GROUP BY feature")
def selection_frequency(spark, d):
    p = _read(spark, d, "orders").where("o_custkey % 11 < 4").select((F.col("o_custkey") % 5).alias("fold"), F.concat_ws(";", "o_orderstatus", F.lower("o_orderpriority")).alias("features"))
    return learn.selection_frequency(p, 5).withColumn("selection_frequency", _r("selection_frequency"))


def _ranked(scope: str) -> str:
    return f"(SELECT l, row_number() OVER (ORDER BY s DESC, l) AS k, s FROM r WHERE scope = '{scope}')"


@query(
    "WITH r AS (SELECT l_returnflag AS scope, l_linenumber AS l, round(avg(l_quantity), 7) AS s FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 2) GROUP BY ALL)"
    f' SELECT coalesce(a.l, n.l)::VARCHAR AS feature, a.k::INTEGER AS "A_rank", a.s AS "A_score", n.k::INTEGER AS "N_rank", n.s AS "N_score" FROM {_ranked("A")} a FULL JOIN {_ranked("N")} n ON a.l = n.l'
)
def instrument_comparison(spark, d):
    """Ranks and scores of two scopes side by side; a feature of one scope only stays."""
    li = _read(spark, d, "lineitem").where("not (l_returnflag = 'A' and l_linenumber = 2)")
    r = li.groupBy(F.col("l_returnflag").alias("scope"), F.col("l_linenumber").cast("string").alias("feature")).agg(_r(F.avg("l_quantity"), 7).alias("score")).withColumns({"mutual_info": F.lit(0.0), "p": F.lit(0.0)})
    each = [W.ranked(r.where(F.col("scope") == x), "score", "feature") for x in ("A", "N")]
    return evaluate.compared(each[0].unionByName(each[1]), ["A", "N"]).select("feature", "A_rank", "A_score", "N_rank", "N_score")


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :])


@query(f"SELECT feature_1, feature_2, round(r, 6) AS r FROM ({PAIRS}) ORDER BY abs(r) DESC LIMIT 3")
def strongest_correlations(spark, d):
    return W.top(stats.correlations(_read(spark, d, "lineitem"), SIGNALS), "r", "feature_1", 3, absolute=True).select("feature_1", "feature_2", _r("r").alias("r"))


@query("SELECT feature, " + ", ".join(f"round({x}, 6) AS {x}" for x in SIGNALS) + " FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, " + ", ".join("1.0" + f" AS {y}" if x == y else f"corr({x}, {y}) AS {y}" for y in SIGNALS) + " FROM lineitem" for x in SIGNALS) + ")")
def correlation_matrix(spark, d):
    m = evaluate.correlation_matrix(stats.correlations(_read(spark, d, "lineitem"), SIGNALS), SIGNALS)
    return m.select("feature", *(_r(x).alias(x) for x in SIGNALS))


@query(
    f"WITH {OL}, {ANOVA}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM v),"
    " q AS (SELECT feature, g, count(*) AS n, sum(rk) AS r FROM r GROUP BY ALL), h AS (SELECT feature, sum(n)::DOUBLE AS n, sum(r * r / n) AS s FROM q GROUP BY feature),"
    " c AS (SELECT feature, sum(pow(t, 3) - t) AS ties FROM (SELECT feature, x, count(*)::DOUBLE AS t FROM v GROUP BY ALL) GROUP BY feature)"
    " SELECT feature, t.n::BIGINT AS n_valid, round((b / (t.k - 1)) / (w / (t.n - t.k)), 5) AS f, round((12 / (h.n * (h.n + 1)) * s - 3 * (h.n + 1)) / (1 - ties / (pow(h.n, 3) - h.n)), 4) AS h FROM t JOIN b USING (feature) JOIN h USING (feature) JOIN c USING (feature)"
)
def discriminative_power(spark, d):
    """F and H of features with ten values at least; a feature of nine is left out."""
    long = _labelled(spark, d)
    few = long.limit(9).withColumn("feature", F.lit("few"))
    return evaluate.discriminative(long.unionByName(few), "o_orderpriority").select("feature", "n_valid", _r("f", 5).alias("f"), _r("h", 4).alias("h"))


@query()
def pm_scores(spark, d):
    long, cov = _shared(spark, d)
    return pca.scores(long, ["participant", "block"], "vec_id", pca.shared_components(cov, None, 64)[1], 7)


@query()
def pm_summary(spark, d):
    long, cov = _shared(spark, d)
    return pca.summary(spark, pca.shared_components(cov, None, 64)[0], 64, long.select("participant", "block").distinct().count())
