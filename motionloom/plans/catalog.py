"""Registered queries of the time-series engine, bound to the tables at hand, and their SQL.

Trials are users of `events` (signal: value), metadata is `customer`, block
matrices are `embeddings` (participant: label, block: vec_id % 3), trial features
are `orders` and `lineitem`, classes are `labels`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.functions import scalars as S
from motionloom.operators import evaluate
from motionloom.operators import features as FE
from motionloom.operators import joins, learn, pca, stats
from motionloom.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STEP = 43200.0
SKILLS = ("Novice", "Advanced Beginner", "Competent", "Expert")
SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6")
    return _read(spark, d, "events").select("event_id", "user_id", "event_type", "value", t.alias("time_s"))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    skill = F.element_at(F.array(*map(F.lit, SKILLS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_mktsegment").alias("instrument"), skill.alias("skill_level"), "c_acctbal")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("label").alias("participant"), (F.col("vec_id") % 3).alias("block"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _r(x, n: int = 6):
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, n)


FRAMES = "e AS (SELECT event_id, user_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS time_s FROM events)"
META = "m AS (SELECT c_custkey AS user_id, lower(c_mktsegment) AS instrument, (['Novice','Advanced Beginner','Competent','Expert'])[c_custkey % 4 + 1] AS skill_level, c_acctbal FROM customer)"
ROM = "r AS (SELECT user_id, count(*) AS n_rows, CASE WHEN count(time_s) >= 2 AND max(time_s) > min(time_s) THEN max(time_s) - min(time_s) WHEN count(*) >= 2 THEN count(*) / 50.0 END AS duration, max(value) - min(value) AS rom FROM e GROUP BY user_id)"
CELLS = "b AS (SELECT label AS participant, vec_id % 3 AS block, vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS signal FROM embeddings)"
LONG = "l AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"


def _rom(spark: SparkSession, d: str) -> DataFrame:
    return stats.range_of_motion(_frames(spark, d), ["user_id"], "time_s", ["value"])


def _long(spark: SparkSession, d: str) -> DataFrame:
    return stats.long_form(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], SIGNALS)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Range of motion per trial, labelled and standardized within the instrument."""
    j = joins.many_to_one(_rom(spark, d), _meta(spark, d), ["user_id"])
    return j.select("user_id", "instrument", _r("ROM_value").alias("rom"), _r(W.zscore("ROM_value", ["instrument"])).alias("rom_z"))


@query(f"WITH {FRAMES}, {ROM} SELECT user_id, n_rows, round(duration, 6) AS duration, round(rom, 6) AS rom, round(CASE WHEN duration > 0 THEN rom / duration END, 9) AS rom_rate FROM r")
def trial_duration_rom(spark, d):
    return _rom(spark, d).select("user_id", "n_rows", _r("duration").alias("duration"), _r("ROM_value").alias("rom"), _r("ROM_rate_value", 9).alias("rom_rate"))


@query(f"WITH {FRAMES}, {ROM}, {META} SELECT r.user_id, round(rom, 6) AS rom, instrument, skill_level, m.user_id IS NOT NULL AS matched FROM r LEFT JOIN m ON r.user_id = m.user_id")
def label_join_many_to_one(spark, d):
    return joins.many_to_one(_rom(spark, d), _meta(spark, d), ["user_id"]).select("user_id", _r("ROM_value").alias("rom"), "instrument", "skill_level", "matched")


@query(f"WITH {FRAMES}, {META} SELECT user_id, 'left' AS side FROM (SELECT DISTINCT user_id FROM e) WHERE user_id NOT IN (SELECT user_id FROM m) UNION ALL SELECT user_id, 'right' FROM m WHERE user_id NOT IN (SELECT user_id FROM e)")
def label_join_unmatched(spark, d):
    return joins.unmatched(_frames(spark, d), _meta(spark, d), ["user_id"])


@query(f"WITH {META}, c AS (SELECT user_id, replace(replace(lower(trim(skill_level)), ' ', '_'), '-', '_') AS label, instrument FROM m) SELECT user_id, label, CASE label WHEN 'competent' THEN 'advanced_beginner' ELSE label END AS three, CASE WHEN label IN ('novice', 'expert') THEN label END AS two, CASE WHEN instrument IN ('violin', 'clarinet') THEN instrument ELSE 'default' END AS kind FROM c")
def canonical_labels(spark, d):
    m = _meta(spark, d)
    return m.select("user_id", S.canonical_label(F.col("skill_level")).alias("label"), S.task_label(F.col("skill_level"), "3class").alias("three"), S.task_label(F.col("skill_level"), "2class").alias("two"), S.instrument(F.col("instrument")).alias("kind"))


@query("SELECT o_orderkey, upper(trim(concat(' p', o_custkey, ' '))) AS participant_id, lower(trim(o_orderpriority)) AS condition, TRY_CAST(trim(substr(o_orderpriority, 1, 1)) AS INTEGER) AS block FROM orders")
def key_standardize(spark, d):
    o = _read(spark, d, "orders")
    return o.select("o_orderkey", S.participant(F.concat(F.lit(" p"), "o_custkey", F.lit(" "))).alias("participant_id"), S.condition(F.col("o_orderpriority")).alias("condition"), S.block(F.substring("o_orderpriority", 1, 1)).alias("block"))


@query(f"WITH {FRAMES}, {ROM}, {META} SELECT r.user_id, instrument, round(rom, 6) AS rom, round(CASE WHEN count(rom) OVER w >= 2 AND stddev_pop(rom) OVER w > 0 THEN (rom - avg(rom) OVER w) / stddev_pop(rom) OVER w END, 6) AS rom_z FROM r LEFT JOIN m USING (user_id) WINDOW w AS (PARTITION BY instrument)")
def zscore_by_group(spark, d):
    return flagship(spark, d)


GAPS = "g AS (SELECT *, CASE WHEN i % 23 BETWEEN 4 AND 15 OR i % 23 = 19 THEN NULL ELSE value END AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_s, event_id) - 1 AS i FROM e))"


def _gaps(spark, d):
    df = W.indexed(_frames(spark, d), ["user_id"], ["time_s", "event_id"])
    k = F.col("i") % 23
    return df.withColumn("v", F.when(~(k.between(4, 15) | (k == 19)), F.col("value")))


@query(f"WITH {FRAMES}, {GAPS}, p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS qi, first_value(v IGNORE NULLS) OVER z AS qv FROM g WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i - pi <= 5 OR qi - i <= 5 THEN CASE WHEN pi IS NULL THEN qv WHEN qi IS NULL THEN pv ELSE pv + (qv - pv) * (i - pi) / (qi - pi) END END, 6) AS filled FROM p")
def gap_fill_limit5(spark, d):
    return W.gap_filled(_gaps(spark, d), ["user_id"], "i", "v").select("event_id", _r("filled").alias("filled"))


@query(f"WITH {FRAMES}, {GAPS} SELECT user_id, count(*) AS n_rows, count(*) - count(v) AS n_missing FROM g GROUP BY user_id")
def gap_counts(spark, d):
    return _gaps(spark, d).groupBy("user_id").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("v")).alias("n_missing"))


@query(f"WITH {FRAMES} SELECT user_id, day, value FROM (SELECT user_id, floor(time_s / 86400)::BIGINT AS day, value, row_number() OVER (PARTITION BY user_id, floor(time_s / 86400) ORDER BY event_id) AS n FROM e) WHERE n = 1")
def dedupe_time(spark, d):
    df = _frames(spark, d).withColumn("day", F.floor(F.col("time_s") / 86400).cast("long"))
    return W.first_per_time(df, ["user_id"], "day", "event_id").select("user_id", "day", "value")


@query(f"WITH {FRAMES}, s AS (SELECT user_id, time_s - lag(time_s) OVER (PARTITION BY user_id ORDER BY time_s) AS d FROM e) SELECT user_id, round(median(d), 6) AS step, round(CASE WHEN median(d) > 0 THEN 1 / median(d) END, 9) AS fs FROM s GROUP BY user_id")
def sampling_step(spark, d):
    return W.sampling_step(_frames(spark, d), ["user_id"], "time_s").select("user_id", _r("step").alias("step"), _r("fs", 9).alias("fs"))


GRID = f"""span AS (SELECT user_id, min(time_s) AS a, max(time_s) AS z FROM e GROUP BY user_id),
grid AS (SELECT user_id, unnest(range(CAST(ceil((z - a) / {STEP} + 0.5) AS BIGINT))) AS j, a FROM span),
u AS (SELECT user_id, NULL::BIGINT AS j, time_s AS t, value AS v FROM e UNION ALL SELECT user_id, j, a + j * {STEP}, NULL FROM grid),
pq AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER z AS qt, first_value(v IGNORE NULLS) OVER z AS qv FROM u WINDOW a AS (PARTITION BY user_id ORDER BY t, j IS NOT NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY t, j IS NULL ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT user_id, j::INTEGER AS j, CASE WHEN qt IS NULL OR pt = qt THEN pv WHEN pt IS NULL THEN qv ELSE pv + (qv - pv) * (t - pt) / (qt - pt) END AS v FROM pq WHERE j IS NOT NULL)"""


def _uniform(spark, d):
    return W.resampled(_frames(spark, d), ["user_id"], "time_s", "value", STEP)


@query(f"WITH {FRAMES}, {GRID} SELECT user_id, j, round(v, 6) AS v FROM s")
def resample_uniform(spark, d):
    return _uniform(spark, d).select("user_id", "j", _r("v").alias("v"))


@query(f"WITH {FRAMES}, {GRID}, n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY j)) SELECT user_id, j, round(1000 * abs(CASE WHEN b IS NULL THEN (a - v) / {STEP} WHEN a IS NULL THEN (v - b) / {STEP} ELSE (a - b) / (2 * {STEP}) END), 6) AS speed, round(1e9 * (a - 2 * v + b) / ({STEP} * {STEP}), 6) + 0.0 AS jerk FROM n")
def gradient_speed(spark, d):
    g = W.second_difference(W.gradient(_uniform(spark, d), ["user_id"], "j", "v", STEP), ["user_id"], "j", "v", STEP)
    return g.select("user_id", "j", _r(1000 * F.abs("gradient")).alias("speed"), (_r(1e9 * F.col("jerk")) + 0.0).alias("jerk"))


@query(f"WITH {FRAMES}, g AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY time_s, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e), w AS (SELECT DISTINCT user_id, unnest(range((n - 10) // 3 + 1)) AS k FROM g WHERE n >= 10) SELECT w.user_id, CAST(k AS BIGINT) AS \"window\", count(value) AS n, round(avg(value), 6) AS mean FROM w JOIN g ON w.user_id = g.user_id AND i BETWEEN k * 3 AND k * 3 + 9 GROUP BY ALL")
def sliding_window_stats(spark, d):
    df = W.indexed(_frames(spark, d), ["user_id"], ["time_s", "event_id"])
    return W.sliding(df, ["user_id"], "i", "value", 10, 3).select("user_id", F.col("window").cast("long").alias("window"), "n", _r("mean").alias("mean"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n_trials, round(CASE WHEN count(o_totalprice) >= 2 AND avg(o_totalprice) <> 0 THEN stddev_pop(o_totalprice) / avg(o_totalprice) END, 6) AS cv FROM orders GROUP BY ALL")
def across_trial_cv(spark, d):
    return stats.across_trial_cv(_read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_totalprice"]).select("o_custkey", "o_orderpriority", "n_trials", _r("CV_o_totalprice").alias("cv"))


@query("SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 9) AS l_quantity, round(avg(l_tax), 9) AS l_tax, count(DISTINCT l_linenumber) AS n_blocks FROM lineitem GROUP BY ALL")
def participant_aggregate(spark, d):
    return stats.participant_means(_read(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_tax"], "l_linenumber").select("l_suppkey", "l_returnflag", _r("l_quantity", 9).alias("l_quantity"), _r("l_tax", 9).alias("l_tax"), "n_blocks")


@query("WITH a AS (SELECT nullif(o_custkey % 50, 7) AS k, round(avg(o_totalprice), 7) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT nullif(o_custkey % 60, 7) AS k, round(avg(o_totalprice), 7) AS x_var FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT nullif(o_custkey % 70, 7) AS k, count(*) AS n FROM orders GROUP BY 1), ab AS (SELECT coalesce(a.k, b.k) AS k, x, x_var FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k) SELECT coalesce(ab.k, c.k) AS k, x, x_var, n, coalesce(x, x_var) AS first_x FROM ab FULL JOIN c ON ab.k IS NOT DISTINCT FROM c.k")
def coalesce_outer_chain(spark, d):
    o = _read(spark, d, "orders")
    part = lambda n, s: (o.where(F.col("o_orderstatus") == s) if s else o).groupBy(F.nullif(F.col("o_custkey") % n, F.lit(7)).alias("k"))
    a, b, c = part(50, "F").agg(_r(F.avg("o_totalprice"), 7).alias("x")), part(60, "O").agg(_r(F.avg("o_totalprice"), 7).alias("x")), part(70, None).agg(F.count("*").alias("n"))
    return joins.outer_chain([("", a), ("_var", b), ("_n", c)], ["k"]).withColumn("first_x", F.coalesce("x", "x_var"))


def _sds(spark, d):
    return pca.temporal_sd(pca.signals_long(_blocks(spark, d), ["participant", "block"], "v"), ["participant", "block"])


@query(f"WITH {CELLS} SELECT participant, block, signal::INTEGER AS signal, round(stddev_samp(value), 6) AS temporal_sd FROM b GROUP BY ALL")
def temporal_sd_by_signal(spark, d):
    return _sds(spark, d).select("participant", "block", "signal", _r("temporal_sd").alias("temporal_sd"))


@query(f"WITH {CELLS}, s AS (SELECT participant, block, signal, stddev_samp(value) AS sd FROM b GROUP BY ALL) SELECT participant, block, round(avg(sd) FILTER (signal < 20), 6) AS lower_body_mean_sd, round(avg(sd) FILTER (signal >= 20 AND signal < 40), 6) AS trunk_head_mean_sd, round(avg(sd) FILTER (signal >= 40), 6) AS upper_body_mean_sd FROM s GROUP BY participant, block")
def family_sd_pivot(spark, d):
    fam = F.when(F.col("signal") < 20, "lower_body").when(F.col("signal") < 40, "trunk_head").otherwise("upper_body")
    out = pca.family_means(_sds(spark, d), ["participant", "block"], fam, ["lower_body", "trunk_head", "upper_body"])
    return out.select("participant", "block", *(_r(c).alias(c) for c in out.columns[2:]))


@query(f"WITH {CELLS}, s AS (SELECT participant, block, stddev_pop(value) AS sd FROM b GROUP BY ALL), m AS (SELECT participant, block, signal, avg(value) AS m FROM b GROUP BY ALL) SELECT vec_id, b.signal::INTEGER AS signal, round((value - m.m) / sd, 6) AS value FROM b JOIN m ON b.participant = m.participant AND b.block = m.block AND b.signal = m.signal JOIN s ON b.participant = s.participant AND b.block = s.block WHERE sd > 0")
def block_normalize(spark, d):
    return pca.normalized(_blocks(spark, d), ["participant", "block"], "vec_id", "v").select("vec_id", "signal", _r("value").alias("value"))


@query(f"WITH {CELLS}, m AS (SELECT participant, block, signal, avg(value) AS m FROM b GROUP BY ALL) SELECT x.participant, x.block AS block_1, y.block AS block_2, round(sum(x.m * y.m) / sqrt(sum(x.m * x.m)) / sqrt(sum(y.m * y.m)), 6) AS cosine FROM m x JOIN m y ON x.participant = y.participant AND x.signal = y.signal AND x.block < y.block GROUP BY ALL")
def cosine_pairs(spark, d):
    m = pca.signals_long(_blocks(spark, d), ["participant", "block"], "v").groupBy("participant", "block", "signal").agg(F.avg("value").alias("m"))
    v = m.groupBy("participant", "block").agg(F.array_sort(F.collect_list(F.struct("signal", "m"))).alias("s")).select("participant", "block", F.transform("s", lambda e: e["m"]).alias("v"))
    return joins.pairs(v, ["participant"], "block", ["v"]).select("participant", "block_1", "block_2", _r(pca.cosine(F.col("v_1"), F.col("v_2"))).alias("cosine"))


def _shared(spark, d):
    long = pca.normalized(_blocks(spark, d), ["participant", "block"], "vec_id", "v")
    return long, pca.covariance(long, ["participant", "block"], "vec_id", 64)


@query(f"WITH {CELLS}, s AS (SELECT participant, block, stddev_pop(value) AS sd FROM b GROUP BY ALL), m AS (SELECT participant, block, signal, avg(value) AS m FROM b GROUP BY ALL), z AS (SELECT vec_id, b.signal AS i, (value - m.m) / sd AS v FROM b JOIN m ON b.participant = m.participant AND b.block = m.block AND b.signal = m.signal JOIN s ON b.participant = s.participant AND b.block = s.block) SELECT x.i::INTEGER AS i, y.i::INTEGER AS j, round(covar_pop(x.v, y.v), 6) AS cov FROM z x JOIN z y ON x.vec_id = y.vec_id AND x.i <= y.i GROUP BY ALL")
def pm_covariance(spark, d):
    return _shared(spark, d)[1].select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), _r("cov").alias("cov"))


@query()
def pm_loadings(spark, d):
    return pca.loadings(spark, *pca.shared_components(_shared(spark, d)[1], None, 64))


@query()
def pm_rms(spark, d):
    long, cov = _shared(spark, d)
    return pca.usage(long, ["participant", "block"], "vec_id", pca.shared_components(cov, None, 64)[1])


@query()
def pm_cumvar(spark, d):
    share, _ = pca.shared_components(_shared(spark, d)[1], None, 64)
    return spark.createDataFrame([(t, pca.components_needed(share, t)) for t in (0.90, 0.95)], "target double, n_pm int")


@query()
def block_consistency(spark, d):
    b = pca.block_loadings(pca.finite_rows(_blocks(spark, d), ["participant", "block"], "v"), ["participant", "block"], "vec_id", "v")
    return pca.consistency(pca.aligned(b, ["participant"], "block"), ["participant"], "block")


HOLES = "h AS (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_tax']) AS feature, unnest([CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END, CASE WHEN l_linenumber <> 7 THEN l_tax END]) AS value FROM lineitem)"


@query(f"WITH {HOLES} SELECT feature, count(*) AS n_total, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS pct_missing, (count(*) - count(value)) / count(*) > 0.3 AS flag_high_missing FROM h GROUP BY feature")
def missingness(spark, d):
    li = _read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("l_tax"))
    return stats.missingness(stats.long_form(li, [], ["l_quantity", "l_tax"])).withColumn("pct_missing", _r("pct_missing"))


@query(f"WITH {LONG}, m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sp FROM l GROUP BY feature) SELECT l.feature, count(value) AS n_valid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(avg(pow((value - mu) / sp, 3)), 6) AS skewness, round(kurtosis_pop(value), 6) AS kurtosis, round(sqrt(var_pop(value)), 4) AS population_sd, var_pop(value) < 1e-8 AS flag_near_zero_variance FROM l JOIN m USING (feature) GROUP BY l.feature")
def distributions(spark, d):
    return stats.distributions(_long(spark, d)).withColumns({c: _r(c) for c in ("mean", "sd", "skewness", "kurtosis")}).withColumn("population_sd", _r(F.sqrt("variance"), 4)).drop("variance")


BOUNDS = "q AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY feature HAVING count(value) >= 4), k AS (SELECT l.*, a - 1.5 * (z - a) AS lower, z + 1.5 * (z - a) AS upper, value < a - 1.5 * (z - a) OR value > z + 1.5 * (z - a) AS is_iqr, coalesce(abs((value - m) / nullif(s, 0)) > 3, false) AS is_z FROM l JOIN q USING (feature))"


@query(f"WITH {LONG}, {BOUNDS} SELECT feature, count(*) AS n_valid, sum(is_iqr::BIGINT)::BIGINT AS n_iqr, sum(is_z::BIGINT)::BIGINT AS n_z, round(any_value(lower), 4) AS lower, round(any_value(upper), 4) AS upper, round(sum(is_iqr::BIGINT) / count(*), 6) AS pct_iqr, round(sum(is_z::BIGINT) / count(*), 6) AS pct_z FROM k GROUP BY feature")
def outlier_summary(spark, d):
    s, _ = stats.outliers(_long(spark, d), ["l_orderkey", "l_linenumber"])
    return s.withColumns({"lower": _r("lower", 4), "upper": _r("upper", 4), "pct_iqr": _r("pct_iqr"), "pct_z": _r("pct_z")})


STEEP = LONG.replace("l_extendedprice, l_discount, l_tax FROM", "(l_extendedprice * l_extendedprice * l_extendedprice) * (l_extendedprice * l_extendedprice * l_extendedprice) AS l_extendedprice, l_discount, l_tax FROM")


@query(f"WITH {STEEP}, {BOUNDS} SELECT l_orderkey, l_linenumber, feature, value, is_iqr, is_z FROM k WHERE is_iqr OR is_z")
def outlier_detail(spark, d):
    """Of sixth powers of prices, whose upper tail lies outside of the fences."""
    price = F.col("l_extendedprice")
    li = _read(spark, d, "lineitem").withColumn("l_extendedprice", (price * price * price) * (price * price * price))
    return stats.outliers(stats.long_form(li, ["l_orderkey", "l_linenumber"], SIGNALS), ["l_orderkey", "l_linenumber"])[1]


def _labelled(spark, d):
    o = _read(spark, d, "orders").withColumn("y", F.dayofmonth("o_orderdate").cast("double"))
    return stats.long_form(o, ["o_orderpriority"], ["o_totalprice", "y"]).withColumn("feature", F.when(F.col("feature") == "y", "day").otherwise("price"))


OL = "v AS (SELECT o_orderpriority AS g, 'price' AS feature, o_totalprice AS x FROM orders UNION ALL SELECT o_orderpriority, 'day', day(o_orderdate) FROM orders)"
ANOVA = "a AS (SELECT feature, g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM a GROUP BY feature), b AS (SELECT feature, sum(a.n * (m - mean) * (m - mean)) AS b FROM a JOIN t USING (feature) GROUP BY feature)"


@query(f"WITH {OL}, {ANOVA} SELECT feature, t.n::BIGINT AS n, k, round((b / (k - 1)) / (w / (t.n - k)), 6) AS f, round(b / (b + w), 9) AS eta_squared FROM t JOIN b USING (feature)")
def anova_f(spark, d):
    return stats.anova(_labelled(spark, d), "o_orderpriority").select("feature", "n", "k", _r("f").alias("f"), _r("eta_squared", 9).alias("eta_squared"))


@query(f"WITH {OL}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM v), s AS (SELECT feature, g, count(*) AS n, sum(rk) AS r FROM r GROUP BY ALL), t AS (SELECT feature, sum(n)::DOUBLE AS n, count(*) AS k, sum(r * r / n) AS s FROM s GROUP BY feature), c AS (SELECT feature, sum(pow(t, 3) - t) AS ties FROM (SELECT feature, x, count(*)::DOUBLE AS t FROM v GROUP BY ALL) GROUP BY feature) SELECT feature, n::BIGINT AS n, k, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 4) AS h FROM t JOIN c USING (feature)")
def kruskal_h(spark, d):
    return stats.kruskal(_labelled(spark, d), "o_orderpriority").withColumn("h", _r("h", 4))


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), v AS (SELECT l_returnflag AS g, 'residual' AS feature, l_extendedprice - a - b * l_quantity AS x FROM lineitem, f), " + ANOVA + " SELECT feature, t.n::BIGINT AS n, k, round((b / (k - 1)) / (w / (t.n - k)), 4) AS f, round(b / (b + w), 7) AS eta_squared FROM t JOIN b USING (feature)")
def residual_anova(spark, d):
    r = stats.residualized(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return stats.anova(stats.long_form(r, ["l_returnflag"], ["residual"]), "l_returnflag").withColumns({"f": _r("f", 4), "eta_squared": _r("eta_squared", 7)})


@query("SELECT feature_1, feature_2, n, r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]) + ")")
def correlation_pairs(spark, d):
    return stats.correlations(_read(spark, d, "lineitem"), SIGNALS).withColumn("r", _r("r"))


@query("SELECT feature_1, feature_2, n, round(r, 6) AS r, round(abs(r), 6) AS absolute_correlation, abs(r) >= 0.9 AS flag FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, count(*) AS n, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]) + ") WHERE r IS NOT NULL")
def redundancy(spark, d):
    return stats.redundant(_read(spark, d, "lineitem"), SIGNALS).withColumns({"r": _r("r"), "absolute_correlation": _r("absolute_correlation")})


@query("WITH v AS (SELECT l_returnflag AS g, 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem), " + ANOVA + ", p AS (SELECT feature, round(avg(x) FILTER (g = 'A'), 6) AS \"mean_A\", round(avg(x) FILTER (g = 'N'), 6) AS \"mean_N\", round(avg(x) FILTER (g = 'R'), 6) AS \"mean_R\" FROM v GROUP BY feature) SELECT feature, round((b / (k - 1)) / (w / (t.n - k)), 6) AS instrument_f, \"mean_A\", \"mean_N\", \"mean_R\" FROM t JOIN b USING (feature) JOIN p USING (feature)")
def instrument_confound(spark, d):
    out = stats.confound(stats.long_form(_read(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"]), "l_returnflag", ["A", "N", "R"])
    return out.select("feature", *(_r(c).alias(c) for c in out.columns[1:]))


@query()
def composite_rank(spark, d):
    lines = _read(spark, d, "lineitem").join(_read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("y")), "l_orderkey")
    long = stats.long_form(lines, ["l_orderkey", "l_linenumber", "y"], SIGNALS)
    s, _ = stats.outliers(long, ["l_orderkey"])
    r = stats.missingness(long).join(stats.distributions(long), "feature").join(s.select("feature", "pct_iqr"), "feature", "left").join(FE.mutual_information(long, "y"), "feature", "left").join(stats.with_tails(stats.anova(long, "y")).select("feature", "p"), "feature", "left")
    return stats.composite(r.withColumn("significant", F.col("p") < 0.05).withColumn("confounded", F.lit(False))).select("feature", "score", "rank")


SHUFFLE = f"(%s * {learn.FACTOR} + 42) %% {learn.PRIME}"


@query(f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {SHUFFLE % 'doc_id'}, doc_id) - 1) % 5)::INTEGER AS fold FROM labels")
def stratified_folds(spark, d):
    return learn.stratified_folds(_read(spark, d, "labels"), "doc_id", "quality", 5).select("doc_id", "quality", "fold")


@query(f"WITH p AS (SELECT o_custkey AS g, min(o_custkey % 3) AS l, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT g, (row_number() OVER (PARTITION BY l ORDER BY n DESC, {SHUFFLE % 'g'}, g) - 1) % 10 AS u FROM p) SELECT o_orderkey, (CASE WHEN u < 5 THEN u ELSE 9 - u END)::INTEGER AS fold FROM orders JOIN f ON o_custkey = g")
def grouped_folds(spark, d):
    o = _read(spark, d, "orders").withColumn("y", F.col("o_custkey") % 3)
    return learn.grouped_folds(o, "o_custkey", "y", 5).select("o_orderkey", "fold")


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END, (SELECT median(l_quantity) FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber <> 1)), 6) AS l_quantity FROM lineitem")
def impute_median(spark, d):
    """Medians of the training part (lines after the first) fill both parts."""
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("l_quantity"))
    train, test, _ = learn.imputed(li.where("l_linenumber <> 1"), li.where("l_linenumber = 1"), ["l_quantity"])
    return train.unionByName(test).withColumn("l_quantity", _r("l_quantity"))


PRUNED = ["l_discount", "l_extendedprice", "l_quantity", "l_tax", "l_twice"]
NEAR = "[" + ", ".join("list_filter([" + ", ".join(f"CASE WHEN abs(corr({a}, {b})) >= 0.9 THEN '{a}' END" for a in PRUNED[:i]) + "], lambda x: x IS NOT NULL)" if i else "[]::VARCHAR[]" for i, b in enumerate(PRUNED)) + "]"


@query(f"WITH RECURSIVE f AS (SELECT {PRUNED} AS names, {NEAR} AS near FROM (SELECT *, l_quantity * 2 + l_tax AS l_twice FROM lineitem)), k AS (SELECT 0 AS i, []::VARCHAR[] AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(kept, near[i + 1])) > 0 THEN kept ELSE list_append(kept, names[i + 1]) END FROM k, f WHERE i < {len(PRUNED)}) SELECT unnest(kept) AS feature FROM k WHERE i = {len(PRUNED)}")
def correlation_prune(spark, d):
    li = _read(spark, d, "lineitem").select(*SIGNALS, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("l_twice"))
    return spark.createDataFrame([(f,) for f in learn.pruned(li, PRUNED)], "feature string")


def _judged(spark, d):
    return _read(spark, d, "labels").withColumn("predicted", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("fold", (F.col("doc_id") % 3).cast("int"))


CONFUSION = "j AS (SELECT doc_id % 3 AS fold, quality, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS predicted FROM labels), grid AS (SELECT DISTINCT fold::INTEGER AS fold, c.quality::INTEGER AS quality, p.predicted::INTEGER AS predicted FROM j, (VALUES (0), (1)) c(quality), (VALUES (0), (1)) p(predicted)), m AS (SELECT g.fold, g.quality, g.predicted, count(j.fold) AS n FROM grid g LEFT JOIN j ON g.fold = j.fold AND g.quality = j.quality AND g.predicted = j.predicted GROUP BY ALL)"
PER = "t AS (SELECT fold, quality AS class, sum(n) AS support, sum(CASE WHEN quality = predicted THEN n ELSE 0 END) AS hits FROM m GROUP BY ALL), p AS (SELECT fold, predicted AS class, sum(n) AS said FROM m GROUP BY ALL), x AS (SELECT fold, class, support, coalesce(hits / nullif(said, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM t JOIN p USING (fold, class)), y AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM x)"


@query(f"WITH {CONFUSION} SELECT * FROM m")
def confusion_matrix(spark, d):
    return stats.confusion(_judged(spark, d), "quality", "predicted", [0, 1], ["fold"])


@query(f"WITH {CONFUSION}, {PER} SELECT fold, class, support::BIGINT AS support, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(f1, 6) AS f1 FROM y")
def class_metrics(spark, d):
    m = stats.metrics(confusion_matrix(spark, d), "quality", "predicted", ["fold"]).drop("said")
    return m.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


@query(f"WITH {CONFUSION}, {PER}, o AS (SELECT fold, avg(re) FILTER (support > 0) AS ba, avg(f1) AS mf, sum(f1 * support) / sum(support) AS wf FROM y GROUP BY fold) SELECT round(avg(ba), 6) AS balanced_accuracy_mean, round(stddev_samp(ba), 6) AS balanced_accuracy_sd FROM o")
def confusion_metrics(spark, d):
    o = stats.overall(stats.metrics(confusion_matrix(spark, d), "quality", "predicted", ["fold"]), ["fold"])
    s = learn.fold_summary(o, "balanced_accuracy")
    return s.select(*(_r(c).alias(c) for c in s.columns))


@query(f"WITH {FRAMES}, g AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY time_s, event_id) - 1 AS i FROM e) SELECT user_id, count(*)::INTEGER AS n, round(sum(value::FLOAT::DOUBLE * (i % 7 + 1)), 2) AS weighted FROM g GROUP BY user_id HAVING count(*) >= 8")
def sequence_assembly(spark, d):
    df = W.indexed(_frames(spark, d), ["user_id"], ["time_s", "event_id"]).withColumns({"b": F.col("value"), "c": F.col("value")})
    s = learn.sequences(df, ["user_id"], "i", ["value", "b", "c"])
    each = F.transform("seq", lambda x, i: x[0].cast("double") * (i % 7 + 1))
    return s.select("user_id", "n", _r(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 2).alias("weighted"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1")
def value_counts(spark, d):
    return _read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_nations"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def joined_participants(spark, d):
    return _read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("segments"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS duplicate FROM lineitem")
def duplicate_keys(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", W.duplicated(["l_orderkey", "l_suppkey"]).alias("duplicate"))


@query(f"WITH {FRAMES}, {ROM} SELECT user_id, round(rom, 6) AS rom FROM r ORDER BY rom DESC, user_id LIMIT 10")
def top_features(spark, d):
    return W.top(_rom(spark, d).select("user_id", _r("ROM_value").alias("rom")), "rom", "user_id")


@query("SELECT n_name, o_orderkey, rank() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY c_nationkey, o_totalprice) - 1) / 2.0 AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def average_ranks(spark, d):
    o = _read(spark, d, "orders").join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("n_name", "o_orderkey", W.average_rank("o_totalprice", ["c_nationkey"]).alias("r"))


@query()
def mutual_info(spark, d):
    o = _read(spark, d, "orders")
    return FE.mutual_information(stats.long_form(o, ["o_orderstatus"], ["o_totalprice", "o_custkey"]), "o_orderstatus")


# five classes: with 4 and m degrees of freedom the tail is x^(m/2) * (1 + m/2 * (1 - x)), x = m / (m + 4 F)
@query(f"WITH {OL}, {ANOVA}, s AS (SELECT feature, t.n - t.k AS m, (b / (t.k - 1)) / (w / (t.n - t.k)) AS f FROM t JOIN b USING (feature)) SELECT feature, round(pow(m / (m + 4 * f), m / 2) * (1 + m / 2 * (1 - m / (m + 4 * f))), 6) AS p FROM s")
def tail_p(spark, d):
    return stats.with_tails(stats.anova(_labelled(spark, d), "o_orderpriority")).select("feature", _r("p").alias("p"))


SD = "v AS (SELECT o_orderstatus AS instrument, o_orderpriority AS g, o_custkey::DOUBLE AS d, 'price' AS feature, o_totalprice AS x FROM orders UNION ALL SELECT o_orderstatus, o_orderpriority, o_custkey, 'day', day(o_orderdate) FROM orders)"


def _anova_sql(x: str, n: str) -> str:
    return f"{n}g AS (SELECT instrument, feature, g, count(*) AS n, avg({x}) AS m, var_pop({x}) AS v FROM y GROUP BY ALL HAVING count(*) >= 2), {n}t AS (SELECT instrument, feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM {n}g GROUP BY ALL), {n} AS (SELECT instrument, feature, any_value(t.n)::BIGINT AS n, any_value(k) AS k, sum(q.n * (m - mean) * (m - mean)) AS b, any_value(w) AS w FROM {n}g q JOIN {n}t t USING (instrument, feature) GROUP BY ALL)"


@query(f"WITH {SD}, l AS (SELECT instrument, feature, count(*) AS n, regr_slope(x, d) AS b, regr_intercept(x, d) AS a, corr(x, d) AS r FROM v GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT g) >= 2), y AS (SELECT v.*, x - a - b * d AS res FROM v JOIN l USING (instrument, feature)), {_anova_sql('x', 'raw')}, {_anova_sql('res', 'rsd')} SELECT instrument, feature, l.n AS n_participants, round(r, 6) AS duration_r, round((raw.b / (raw.k - 1)) / (raw.w / (raw.n - raw.k)), 5) AS raw_f, round(raw.b / (raw.b + raw.w), 8) AS raw_eta_squared, round((rsd.b / (rsd.k - 1)) / (rsd.w / (rsd.n - rsd.k)), 5) AS residual_f FROM l JOIN raw USING (instrument, feature) JOIN rsd USING (instrument, feature)")
def skill_duration_evaluation(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderstatus").alias("instrument"), F.col("o_orderpriority").alias("g"), F.col("o_custkey").cast("double").alias("d"), F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").alias("day"))
    r = evaluate.skill_duration(stats.long_form(o, ["instrument", "g", "d"], ["price", "day"]), ["instrument"], "g", "d")
    return r.select("instrument", "feature", "n_participants", _r("duration_r").alias("duration_r"), _r("raw_f", 5).alias("raw_f"), _r("raw_eta_squared", 8).alias("raw_eta_squared"), _r("residual_f", 5).alias("residual_f"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS feature_1, '{b}' AS feature_2, count(*) AS n_participants, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) >= 0.9 AS flag FROM lineitem GROUP BY 1 HAVING count(*) >= 5" for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]) + ")")
def redundancy_by_instrument(spark, d):
    return evaluate.redundancy_by(_read(spark, d, "lineitem"), "l_returnflag", SIGNALS).withColumn("r", _r("r"))


@query("WITH c AS (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS feature, unnest([count(CASE WHEN l_returnflag <> 'A' THEN l_quantity END), count(l_tax)]) AS n FROM lineitem GROUP BY 1) SELECT feature, min(n) AS least_valid, min(n) >= 2 AS kept FROM c GROUP BY feature")
def feature_support(spark, d):
    li = _read(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return evaluate.support(stats.long_form(li, ["l_returnflag"], ["l_quantity", "l_tax"]), ["l_returnflag"])


def _bundle(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").cast("double").alias("day"), F.lit(1.0).alias("still"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("half"), "o_orderpriority", "o_orderstatus")
    return evaluate.bundle(o, ["o_orderkey"], ["price", "day", "still", "half"], "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query()
def report_ranking(spark, d):
    return _bundle(spark, d)["ranking"].select("scope", "feature", "score", "rank")


@query()
def report_summary(spark, d):
    return evaluate.bundle_summary(_bundle(spark, d))


def _trials(spark, d):
    # a study: one row for each participant
    a = _read(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("most"), F.count("*").cast("double").alias("n_orders"))
    a = a.withColumn("y", F.when(F.col("n_orders") >= 15, 2).when(F.col("n_orders") >= 9, 1).otherwise(0))
    return learn.stratified_folds(a, "o_custkey", "y", 3)


def _cv(spark, d, model, **how):
    p = learn.cross_validated(_trials(spark, d), ["price", "most", "n_orders"], "y", model, [0, 1, 2], **how)
    return p.select("o_custkey", "fold", "y", "prediction")


@query()
def logreg_cv(spark, d):
    return _cv(spark, d, "logistic")


@query()
def svm_cv(spark, d):
    return _cv(spark, d, "svm", c=0.1)


@query()
def forest_cv(spark, d):
    return _cv(spark, d, "forest")


@query()
def rnn_cv(spark, d):
    df = W.indexed(_frames(spark, d), ["user_id"], ["time_s", "event_id"])
    df = df.withColumns({"x1": F.log1p(F.abs("value")), "x2": F.coalesce(F.col("value") - F.lag("value").over(W._trial(["user_id"]).orderBy("i")), F.lit(0.0)), "x3": F.col("i") / 50.0})
    s = learn.sequences(df, ["user_id"], "i", ["x1", "x2", "x3"]).join(_meta(spark, d).withColumn("label", S.task_label(F.col("skill_level"), "2class")), "user_id").where("label is not null").withColumn("y", (F.col("label") == "expert").cast("int"))
    return learn.recurrent_cv(learn.stratified_folds(s, "user_id", "y", 3).select("user_id", "y", "fold", "seq"), "user_id", "y", epochs=3, hidden=16, layers=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from motionloom.plans import study_queries  # noqa: F401  it registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
