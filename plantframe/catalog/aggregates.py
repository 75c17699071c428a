"""Aggregations: profiles, tests, baselines, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, baseline, cluster, constraints, intervals, packets, profile, rolling, scoring
from .base import BUCKETED, BUCKET_S, FLOWS, FLOW_FEATURES, READINGS, SENSORS, Tables, WINDOWS, query, r
from .joins import flow_days
from .projections import matched, nulled, packet_table, MATCHED, NULLED

UNPIVOT = "UNPIVOT ({src}) ON {cols} INTO NAME feature VALUE v"
FEATURE_LIST = ", ".join(FLOW_FEATURES)


def long_sql(src: str, cols: str = FEATURE_LIST) -> str:
    return f"({UNPIVOT.format(src=src, cols=cols)})"


LONG_FLOWS = long_sql(f"SELECT l_returnflag, {FEATURE_LIST} FROM lineitem")


@query(
    "agg_class_distribution",
    "SELECT l_returnflag, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS pct FROM lineitem GROUP BY 1",
)
def agg_class_distribution(t: Tables):
    return profile.class_distribution(t.lineitem, "l_returnflag").select("l_returnflag", "n", r("pct"))


SPREADS = ", ".join(
    f"round(var_samp(value) FILTER (sensor = '{s}'), 7) AS plc_var_{s}, round(max(value) FILTER (sensor = '{s}') - min(value) FILTER (sensor = '{s}'), 6) AS plc_range_{s}"
    for s in SENSORS
)


@query("agg_bucket_var_range", f"WITH {BUCKETED} SELECT series, bucket, {SPREADS} FROM bucketed GROUP BY 1, 2")
def agg_bucket_var_range(t: Tables):
    wide = align.spread_wide(t.bucketed, ["series", "bucket"], SENSORS, "plc")
    return wide.select("series", "bucket", *[x for s in SENSORS for x in (r(f"plc_var_{s}", 7), r(f"plc_range_{s}"))])


@query("agg_bucket_count", f"WITH {FLOWS} SELECT t_us // 86400000000 * 86400 AS bucket, count(*) AS n FROM flows GROUP BY 1")
def agg_bucket_count(t: Tables):
    return flow_days(t).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_variance_by_window",
    f"""WITH base AS (SELECT feature, var_samp(v) FILTER (l_returnflag = 'N') AS var_normal, var_samp(v) FILTER (l_returnflag <> 'N') AS var_attack
      FROM {LONG_FLOWS} GROUP BY 1)
    SELECT feature, round(var_normal, 3) AS var_normal, round(var_attack, 3) AS var_attack, round(var_attack / var_normal, 6) AS ratio FROM base""",
)
def agg_variance_by_window(t: Tables):
    v = profile.variance_by_part(t.lineitem, FLOW_FEATURES, F.col("l_returnflag") != "N")
    return v.select("feature", r("var_normal", 3), r("var_attack", 3), r("ratio"))


FIRST_LATE = """cut AS (SELECT min(start_us) AS c FROM windows WHERE attack = 'port-scan')"""


def warm_readings(t: Tables):
    """Readings before the first port scan."""
    marked = intervals.split_by_first_window(t.readings, "t_us", t.windows.filter("attack = 'port-scan'"), "start_us", "end_us")
    return marked.filter("part = 'before'").drop("part")


STREAM_BASE = FIRST_LATE + """, base AS (SELECT series, sensor, avg(value) AS mean, coalesce(nullif(stddev_samp(value), 0), 1e-6) AS std,
    coalesce(nullif(var_samp(value), 0), 1e-9) AS variance, count(value) AS n_rows
    FROM readings WHERE t_us < (SELECT c FROM cut) GROUP BY 1, 2 HAVING count(value) >= 30)"""


@query(
    "agg_baseline_stream",
    f"WITH {WINDOWS}, {STREAM_BASE} SELECT series, sensor, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 5) AS variance, n_rows FROM base",
)
def agg_baseline_stream(t: Tables):
    b = baseline.detector_baseline(warm_readings(t))
    return b.select("series", "sensor", r("mean"), r("std"), r("variance", 5), "n_rows")


WARM_BUCKETS = """ranked AS (SELECT series, bucket, row_number() OVER (PARTITION BY series ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY series) AS nb
    FROM (SELECT DISTINCT series, bucket FROM bucketed)),
  warm AS (SELECT b.* FROM bucketed b JOIN ranked USING (series, bucket) WHERE rn <= greatest(5, floor(0.15 * nb))),
  wbase AS (SELECT series, sensor, avg(value) AS mean, coalesce(nullif(stddev_samp(value), 0), 1e-6) AS std,
    coalesce(nullif(var_samp(value), 0), 1e-12) AS variance, count(value) AS n_rows FROM warm GROUP BY 1, 2 HAVING count(value) >= 5)"""


def warm_by_buckets(t: Tables):
    b = t.bucketed
    chosen = baseline.warmup_buckets(b, ["series"], "bucket", 0.15, 5)
    return b.join(chosen, ["series", "bucket"], "left_semi")


@query(
    "agg_baseline_window",
    f"""WITH {BUCKETED}, {WARM_BUCKETS}, counts AS (SELECT series, count(*) / count(DISTINCT bucket)::DOUBLE AS per FROM warm GROUP BY 1)
    SELECT series, sensor, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 5) AS variance, n_rows, round(greatest(per, 1.0), 6) AS rows_per_bucket
    FROM wbase JOIN counts USING (series)""",
)
def agg_baseline_window(t: Tables):
    warm = warm_by_buckets(t)
    per = warm.groupBy("series", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("series").agg(F.greatest(F.avg("n"), F.lit(1.0)).alias("rows_per_bucket"))
    b = baseline.window_baseline(warm).join(per, "series")
    return b.select("series", "sensor", r("mean"), r("std"), r("variance", 5), "n_rows", r("rows_per_bucket"))


TAG_BASE = """wrows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t_us, row_id) AS rn, count(*) OVER (PARTITION BY series) AS nr FROM readings)
    WHERE rn <= greatest(10, floor(0.15 * nr))),
  steps AS (SELECT series, sensor, value, abs(value - lag(value) OVER (PARTITION BY series, sensor ORDER BY t_us, row_id)) AS step FROM wrows),
  tbase AS (SELECT series, sensor AS tag, avg(value) AS mean, stddev_pop(value) + 1e-12 AS std, var_pop(value) + 1e-12 AS variance,
    quantile_cont(step, 0.99) AS max_delta_per_step, count(*) AS n_samples FROM steps GROUP BY 1, 2 HAVING count(*) >= 2)"""


def tag_base(t: Tables, readings=None):
    warm = baseline.warmup_rows(readings if readings is not None else t.readings, ["series"], 0.15, 86400)
    return baseline.tag_baseline(warm.withColumnRenamed("sensor", "tag"), ["series", "tag"], 86400)


@query(
    "agg_baseline_tags",
    f"""WITH {READINGS}, {TAG_BASE} SELECT series, tag, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 5) AS variance,
    round(max_delta_per_step, 6) AS max_delta_per_step, n_samples FROM tbase""",
)
def agg_baseline_tags(t: Tables):
    return tag_base(t).select("series", "tag", r("mean"), r("std"), r("variance", 5), r("max_delta_per_step"), "n_samples")


@query(
    "agg_null_audit",
    f"""WITH {NULLED} SELECT feature, n_null, round(n_null * 100.0::DOUBLE / (SELECT count(*) FROM nulled), 6) AS pct_null FROM (
      SELECT 'a' AS feature, count(*) FILTER (a IS NULL) AS n_null FROM nulled UNION ALL SELECT 'b', count(*) FILTER (b IS NULL) FROM nulled)""",
)
def agg_null_audit(t: Tables):
    return profile.null_audit(nulled(t), ["event_id", "a", "b"]).select("feature", "n_null", r("pct_null"))


@query(
    "agg_skew",
    "SELECT 'value' AS feature, round(skewness(value), 6) AS skew FROM events",
)
def agg_skew(t: Tables):
    return profile.skew(t.events, ["value", "user_id"]).select("feature", r("skew"))


@query("agg_zero_inflation", f"SELECT feature, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM {LONG_FLOWS} GROUP BY 1")
def agg_zero_inflation(t: Tables):
    return profile.zero_share(t.lineitem, FLOW_FEATURES).select("feature", r("zero_share"))


@query(
    "agg_near_constant",
    f"SELECT feature, round(stddev_samp(v), 9) AS std FROM {long_sql('SELECT l_discount * 1e-6 AS small, l_tax * 0 AS still, l_quantity FROM lineitem', 'small, still, l_quantity')} GROUP BY 1 HAVING stddev_samp(v) < 1e-6",
)
def agg_near_constant(t: Tables):
    li = t.lineitem.select((F.col("l_discount") * 1e-6).alias("small"), (F.col("l_tax") * 0).alias("still"), "l_quantity")
    return profile.near_constant(li, li.columns).select("feature", r("std", 9))


@query("agg_top_variance", f"SELECT feature, round(var_samp(v), 3) AS variance FROM {LONG_FLOWS} GROUP BY 1 ORDER BY var_samp(v) DESC, 1 LIMIT 3")
def agg_top_variance(t: Tables):
    return profile.top_variance(t.lineitem, FLOW_FEATURES, 3).select("feature", r("variance", 3))


@query(
    "agg_histogram",
    f"""WITH l AS (SELECT l_returnflag, feature, v FROM {LONG_FLOWS}),
    m AS (SELECT l_returnflag, feature, min(v) AS lo, max(v) AS hi, count(*) AS total FROM l GROUP BY 1, 2)
    SELECT l_returnflag, feature, CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n,
      round(count(*) / (any_value(total) * any_value((hi - lo) / 40)), 6) AS density FROM l JOIN m USING (l_returnflag, feature) GROUP BY 1, 2, 3""",
)
def agg_histogram(t: Tables):
    return profile.histogram(t.lineitem, FLOW_FEATURES, "l_returnflag", 40).select("l_returnflag", "feature", "bin", "n", r("density"))


@query(
    "agg_alert_density",
    f"""WITH {READINGS}, a AS (SELECT sensor, (t_us - (SELECT min(t_us) FROM readings)) / 1e6 AS el FROM readings WHERE value > 100)
    SELECT sensor, CAST(least(floor(el / ((SELECT max(el) FROM a) / 99)), 98) AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY 1, 2""",
)
def agg_alert_density(t: Tables):
    a = align.with_elapsed(t.readings, [], "t_us").filter("value > 100")
    return profile.density_over_time(a, "elapsed_s", "sensor")


@query(
    "agg_corr_matrix",
    f"""WITH coded AS (SELECT *, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE AS code FROM lineitem),
    r AS (SELECT feature, corr(v, code) AS r FROM (UNPIVOT (SELECT code, {FEATURE_LIST} FROM coded) ON {FEATURE_LIST} INTO NAME feature VALUE v) GROUP BY 1),
    top AS (SELECT feature FROM r ORDER BY abs(r) DESC, feature LIMIT 3),
    l AS (SELECT row_number() OVER () AS i, {FEATURE_LIST} FROM lineitem),
    u AS (SELECT i, feature, v FROM (UNPIVOT l ON {FEATURE_LIST} INTO NAME feature VALUE v) WHERE feature IN (SELECT feature FROM top))
    SELECT a.feature AS a, b.feature AS b, round(corr(a.v, b.v), 6) AS r FROM u a JOIN u b USING (i) GROUP BY 1, 2""",
)
def agg_corr_matrix(t: Tables):
    top = profile.correlation_with_label(t.lineitem, FLOW_FEATURES, "l_returnflag", 3)
    names = sorted(row["feature"] for row in top.select("feature").collect())
    return profile.correlation(t.lineitem, names).select("a", "b", r("r"))


@query(
    "agg_mann_whitney",
    f"""WITH c AS (SELECT feature, v, count(*) FILTER (l_returnflag <> 'N') AS n1, count(*) FILTER (l_returnflag = 'N') AS n0 FROM {LONG_FLOWS} GROUP BY 1, 2),
    p AS (SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY v) - n0 AS before FROM c),
    s AS (SELECT feature, sum(n1 * (before + n0 / 2)) AS u, sum(n1)::BIGINT AS n1, sum(n0)::BIGINT AS n0 FROM p GROUP BY 1),
    e AS (SELECT feature, sum((n1 + n0)::DOUBLE ** 3 - (n1 + n0)) AS ties FROM c GROUP BY 1),
    z AS (SELECT *, n1::DOUBLE * n0 AS m, (n1 + n0)::DOUBLE AS k FROM s JOIN e USING (feature)),
    x AS (SELECT *, greatest(abs(u - m / 2) - 0.5, 0) / sqrt(m / 12 * ((k + 1) - ties / (k * (k - 1)))) / sqrt(2.0) AS x FROM z),
    y AS (SELECT *, 1 / (1 + 0.5 * x) AS y FROM x)
    -- the logarithm of the normal tail by a rational approximation with a relative error below 1.2e-7
    SELECT feature, n1, n0, u::DOUBLE AS u, round(abs(2 * u / m - 1), 6) AS effect,
      round(-(ln(y) - x * x - 1.26551223 + y * (1.00002368 + y * (0.37409196 + y * (0.09678418 + y * (-0.18628806 + y * (0.27886807 + y * (-1.13520398 + y * (1.48851587 + y * (-0.82215223 + y * 0.17087277))))))))) / ln(10), 4) + 0 AS neg_log10_p FROM y""",
)
def agg_mann_whitney(t: Tables):
    m = profile.mann_whitney(t.lineitem, FLOW_FEATURES, F.col("l_returnflag") != "N")
    return m.select("feature", "n1", "n0", "u", r("effect"), r(F.col("neg_log10_p") + 0.0, 4, "neg_log10_p"))


@query(
    "agg_chi2_cramers_v",
    """WITH l AS (SELECT l_returnflag AS lab, feature, cat FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)
        ON l_linestatus, l_linenumber INTO NAME feature VALUE cat)),
    o AS (SELECT feature, cat, lab, count(*)::DOUBLE AS o FROM l GROUP BY 1, 2, 3),
    g AS (SELECT r.feature, r.cat, c.lab, r.m AS rm, c.m AS cm, n FROM (SELECT feature, cat, sum(o) AS m FROM o GROUP BY 1, 2) r
      JOIN (SELECT feature, lab, sum(o) AS m FROM o GROUP BY 1, 2) c USING (feature) JOIN (SELECT feature, sum(o) AS n FROM o GROUP BY 1) USING (feature)),
    x AS (SELECT feature, sum((coalesce(o, 0) - rm * cm / n) ** 2 / (rm * cm / n)) AS chi2, any_value(n) AS n, count(DISTINCT cat) AS k, count(DISTINCT lab) AS m
      FROM g LEFT JOIN o USING (feature, cat, lab) GROUP BY 1)
    -- the tail for an even number of degrees of freedom, which both features have
    SELECT feature, round(chi2, 5) AS chi2, (k - 1) * (m - 1) AS dof, round(sqrt(chi2 / (n * least(k - 1, m - 1))), 6) AS cramers_v,
      round(list_sum(list_transform(range(0, (k - 1) * (m - 1) // 2), lambda i: exp(i * ln(chi2 / 2) - chi2 / 2 - lgamma(i + 1)))), 7) AS p_value FROM x""",
)
def agg_chi2_cramers_v(t: Tables):
    return profile.chi_square(t.lineitem, ["l_linestatus", "l_linenumber"], "l_returnflag").select("feature", r("chi2", 5), "dof", r("cramers_v"), r("p_value", 7))


@query(
    "agg_crosstab_norm",
    """WITH top AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT l_suppkey, l_returnflag, count(*) AS n, round(count(*) / any_value(total)::DOUBLE, 6) AS share FROM lineitem JOIN top USING (l_suppkey) GROUP BY 1, 2""",
)
def agg_crosstab_norm(t: Tables):
    return profile.crosstab_share(t.lineitem, "l_suppkey", "l_returnflag").select("l_suppkey", "l_returnflag", "n", r("share"))


@query(
    "agg_ols_by_class",
    """SELECT l_returnflag, x, y, n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(r, 6) AS r FROM (
      SELECT l_returnflag, 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
        regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 'l_discount', 'l_tax', count(*), regr_slope(l_tax, l_discount), regr_intercept(l_tax, l_discount), corr(l_tax, l_discount) FROM lineitem GROUP BY 1)""",
)
def agg_ols_by_class(t: Tables):
    o = profile.ols_by_class(t.lineitem, "l_returnflag", [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return o.select("l_returnflag", "x", "y", "n", r("slope"), r("intercept", 3), r("r"))


@query(
    "agg_cronbach_alpha",
    """SELECT part, 'rates' AS "group", 2 AS k, round(2.0 * (1 - (var_samp(l_discount) + var_samp(l_tax)) / var_samp(l_discount + l_tax)), 6) AS alpha
      FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'Normal' ELSE 'Attack' END AS part FROM lineitem) GROUP BY 1
    UNION ALL SELECT part, 'all', 3, round(1.5 * (1 - (var_samp(l_discount) + var_samp(l_tax) + var_samp(l_quantity)) / var_samp(l_discount + l_tax + l_quantity)), 6)
      FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'Normal' ELSE 'Attack' END AS part FROM lineitem) GROUP BY 1""",
)
def agg_cronbach_alpha(t: Tables):
    part = F.when(F.col("l_returnflag") == "N", "Normal").otherwise("Attack")
    a = profile.cronbach_alpha(t.lineitem, {"rates": ["l_discount", "l_tax"], "all": ["l_discount", "l_tax", "l_quantity"]}, part)
    return a.select("part", "group", "k", r("alpha"))


SCORES = """scores AS (SELECT win_id, attack, start_us, end_us, count(t_us) AS n_alerts, round((min(t_us) - start_us) / 1e6, 2) AS latency_s, count(t_us) > 0 AS detected
    FROM windows LEFT JOIN (SELECT t_us FROM readings WHERE value > 120) ON t_us BETWEEN start_us AND end_us GROUP BY 1, 2, 3, 4)"""


def big_values(t: Tables):
    return t.readings.filter("value > 120").withColumn("alert_type", F.when(F.col("value") > 160, "z_score_spike").otherwise("variance_collapse"))


def scored_windows(t: Tables):
    return rolling.score_windows(t.windows, ["win_id"], big_values(t), 6 * 3600)


@query(
    "agg_detection_summary",
    f"""WITH {WINDOWS}, {SCORES} SELECT attack, count(*) AS windows, CAST(sum(detected::INT) AS BIGINT) AS detected,
    round(avg(latency_s), 2) AS avg_latency_s, round(avg(detected::INT), 3) AS recall FROM scores GROUP BY 1""",
)
def agg_detection_summary(t: Tables):
    return rolling.summarise_detection(scored_windows(t))


@query(
    "agg_detection_rollup",
    f"""WITH {WINDOWS}, {SCORES} SELECT coalesce(attack, 'ALL') AS attack, count(*) AS windows, CAST(sum(detected::INT) AS BIGINT) AS detected,
    round(avg(latency_s), 2) AS avg_latency_s, round(avg(detected::INT), 4) AS recall FROM scores GROUP BY ROLLUP (attack)""",
)
def agg_detection_rollup(t: Tables):
    return rolling.rollup_detection(scored_windows(t))


IDS = {"C1": 1.0, "C2": 0.85, "C3": 0.95}
VIOL = """viol AS (
    SELECT bucket, 'C1' AS constraint_id FROM bucketed WHERE value > 150 UNION ALL
    SELECT bucket, 'C2' FROM bucketed WHERE sensor = 'view' AND value > 100 UNION ALL
    SELECT bucket, 'C3' FROM bucketed WHERE value < 0.1)"""
FIRED = VIOL + """, fired AS (SELECT w.bucket, count(constraint_id) AS n_viols, list_sort(list_distinct(list(constraint_id) FILTER (constraint_id IS NOT NULL))) AS ids
    FROM (SELECT DISTINCT bucket FROM bucketed) w LEFT JOIN viol USING (bucket) GROUP BY 1)"""


def sample_violations(t: Tables):
    b = t.bucketed
    parts = [
        ("C1", F.col("value") > 150), ("C2", (F.col("sensor") == "view") & (F.col("value") > 100)), ("C3", F.col("value") < 0.1),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in parts]))
    return b.select("bucket", F.explode(hits).alias("constraint_id"))


def sample_results(t: Tables):
    windows = t.bucketed.select("bucket").distinct()
    return constraints.window_results(windows, sample_violations(t), ["bucket"], IDS)


ACTIVE = """active AS (SELECT bucket, list_sort(list_distinct(list('P' || CAST(user_id % 4 + 1 AS VARCHAR)) FILTER (event_type = 'error' AND value > 110))) AS act
    FROM (SELECT *, epoch_us(ts) // 21600000000 * 21600 AS bucket FROM events) GROUP BY 1)"""


@query(
    "agg_constraint_coverage",
    f"""WITH {BUCKETED}, {FIRED}, {ACTIVE}, s AS (SELECT bucket, coalesce(ids, []) AS ids, CASE len(act) WHEN 1 THEN act[1] ELSE 'multi-process' END AS stratum
      FROM fired JOIN active USING (bucket) WHERE len(act) > 0)
    SELECT coalesce(stratum, 'ALL') AS process, count(*) AS n_atk_win, round(100.0 * avg(list_contains(ids, 'C1')::INT), 1) AS "C1_pct",
      round(100.0 * avg(list_contains(ids, 'C2')::INT), 1) AS "C2_pct", round(100.0 * avg(list_contains(ids, 'C3')::INT), 1) AS "C3_pct",
      round(100.0 * avg((len(ids) = 0)::INT), 1) AS invisible_pct FROM s GROUP BY ROLLUP (stratum)""",
)
def agg_constraint_coverage(t: Tables):
    e = t.events
    hit = F.when((F.col("event_type") == "error") & (F.col("value") > 110), F.concat(F.lit("P"), (F.col("user_id") % 4 + 1).cast("string")))
    active = e.groupBy(C.time_bucket(C.epoch_us(e, "ts"), BUCKET_S).alias("bucket")).agg(F.sort_array(F.collect_set(hit)).alias("act"))
    rows = sample_results(t).join(active, "bucket").filter(F.size("act") > 0).withColumn("stratum", scoring.process_stratum(F.col("act")))
    return scoring.coverage_by_stratum(rows, ["C1", "C2", "C3"])


@query(
    "agg_constraint_replay_hits",
    f"""WITH {WINDOWS}, bucketed AS (SELECT *, (t_us // 21600000000) * 21600 AS bucket FROM readings), {VIOL}
    SELECT constraint_id, count(DISTINCT win_id) AS n_windows FROM windows JOIN viol ON bucket * 1000000 BETWEEN start_us AND end_us WHERE attack = 'replay' GROUP BY 1""",
)
def agg_constraint_replay_hits(t: Tables):
    v = sample_violations(t).distinct().withColumn("b_us", F.col("bucket") * C.MICROS)
    hits = intervals.points_in_windows(v, "b_us", t.windows.filter("attack = 'replay'"), "start_us", "end_us", BUCKET_S)
    return hits.select("constraint_id", "win_id").distinct().groupBy("constraint_id").agg(F.count(F.lit(1)).alias("n_windows"))


@query(
    "agg_violation_counts",
    f"""WITH {BUCKETED}, {VIOL} SELECT id AS constraint_id, count(v.constraint_id) AS n_violations FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4')) i(id)
    LEFT JOIN viol v ON v.constraint_id = id GROUP BY 1""",
)
def agg_violation_counts(t: Tables):
    return constraints.violation_counts(sample_violations(t), ["C1", "C2", "C3", "C4"])


Z_SQL = """stats AS (SELECT sensor, avg(value) AS mu, stddev_samp(value) AS sd FROM readings WHERE t_us < 1704844800000000 GROUP BY 1)"""


def train_stats(t: Tables):
    return t.readings.filter("t_us < 1704844800000000").groupBy("sensor").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query(
    "agg_zscore_window",
    f"""WITH {BUCKETED}, {Z_SQL} SELECT bucket, round(max(abs((value - mu) / sd)), 6) AS score, max(abs((value - mu) / sd)) > 5.0 AS flagged
    FROM bucketed JOIN stats USING (sensor) GROUP BY 1""",
)
def agg_zscore_window(t: Tables):
    z = scoring.row_zscore(t.bucketed, train_stats(t), ["bucket"], ["sensor"])
    return z.select("bucket", r("score"), (F.col("score") > 5.0).alias("flagged"))


@query(
    "agg_zscore_process",
    f"""WITH {BUCKETED}, {Z_SQL} SELECT bucket, process, variant, round(max(abs((value - mu) / sd)), 6) AS score FROM (
      SELECT *, CASE WHEN sensor IN ('click', 'view') THEN 'P1' ELSE 'P2' END AS process FROM bucketed JOIN stats USING (sensor))
      JOIN (VALUES ('all', 0.0), ('varying', 48.0)) v(variant, least_sd) ON sd > least_sd GROUP BY 1, 2, 3""",
)
def agg_zscore_process(t: Tables):
    process = F.when(F.col("sensor").isin("click", "view"), "P1").otherwise("P2")
    rows = t.bucketed.withColumn("process", process)
    base = train_stats(t)
    parts = [
        scoring.row_zscore(rows, base.filter(F.col("std") > least), ["bucket", "process"], ["sensor"]).withColumn("variant", F.lit(name))
        for name, least in (("all", 0.0), ("varying", 48.0))
    ]
    return parts[0].unionByName(parts[1]).select("bucket", "process", "variant", r("score"))


@query(
    "agg_confusion_matrix",
    f"""WITH {MATCHED} SELECT event_type, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type)::DOUBLE, 6) AS share
    FROM matched GROUP BY 1, 2""",
)
def agg_confusion_matrix(t: Tables):
    return scoring.confusion(matched(t), "event_type", "predicted").select("event_type", "predicted", "n", r("share"))


CLASS_SQL = """cls AS (SELECT class, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(sp, 0), 0) AS recall, sp AS support, tp FROM (
      SELECT class, (SELECT count(*) FROM matched WHERE event_type = class)::DOUBLE AS sp, (SELECT count(*) FROM matched WHERE predicted = class)::DOUBLE AS pp,
        (SELECT count(*) FROM matched WHERE predicted = class AND event_type = class)::DOUBLE AS tp
      FROM (SELECT event_type AS class FROM matched UNION SELECT predicted FROM matched)))"""


@query(
    "agg_class_metrics",
    f"""WITH {MATCHED}, {CLASS_SQL}, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM cls)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support,
      round(avg(f1) OVER (), 6) AS macro_f1, round(sum(tp) OVER () / sum(support) OVER (), 6) AS accuracy FROM f""",
)
def agg_class_metrics(t: Tables):
    per = scoring.class_metrics(matched(t), "event_type", "predicted")
    total = C.one_value(scoring.overall_metrics(per))
    return per.withColumn("_t", total).select(
        "class", r("precision"), r("recall"), r("f1"), "support", r(F.col("_t.macro_f1"), 6, "macro_f1"), r(F.col("_t.accuracy"), 6, "accuracy")
    )


@query(
    "agg_recall_delta",
    """SELECT model, class, round(b, 4) AS baseline_recall, round(f, 4) AS fused_recall, round(f - b, 4) AS delta FROM (
      SELECT CAST(user_id % 3 AS VARCHAR) AS model, event_type AS class, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS b,
        avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS f FROM events GROUP BY 1, 2)""",
)
def agg_recall_delta(t: Tables):
    def side(limit: int):
        return t.events.groupBy((F.col("user_id") % 3).cast("string").alias("model"), F.col("event_type").alias("class")).agg(
            F.avg((F.col("value") > limit).cast("double")).alias("recall")
        )

    return scoring.recall_delta(side(50), side(30))


@query(
    "agg_method_comparison",
    f"""WITH {MATCHED}, {CLASS_SQL}, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM cls)
    SELECT 'matched' AS method, round(max(recall) FILTER (class = 'error'), 6) AS target_recall, round(max(f1) FILTER (class = 'error'), 6) AS target_f1, round(avg(f1), 6) AS macro_f1 FROM f
    UNION ALL SELECT 'always', 1.0, round(2.0 * p / (p + 1), 6), round(2.0 * p / (p + 1) / 5, 6) FROM (SELECT avg((event_type = 'error')::INT) AS p FROM events)""",
)
def agg_method_comparison(t: Tables):
    m = matched(t)
    always = scoring.class_metrics(m.withColumn("predicted", F.lit("error")), "event_type", "predicted")
    rows = scoring.method_row(scoring.class_metrics(m, "event_type", "predicted"), "matched", "error").unionByName(
        scoring.method_row(always, "always", "error")
    )
    return rows.select("method", r("target_recall"), r("target_f1"), r("macro_f1"))


@query(
    "agg_cluster_majority",
    """SELECT cluster, event_type AS majority, n, CAST(total AS BIGINT) AS total FROM (SELECT user_id % 10 AS cluster, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id % 10) AS total FROM events GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, event_type) = 1""",
)
def agg_cluster_majority(t: Tables):
    return cluster.majority_label(t.events.withColumn("cluster", F.col("user_id") % 10), "cluster", "event_type")


@query(
    "agg_cluster_profile",
    f"""WITH l AS (SELECT l_returnflag AS cluster, feature, v FROM {LONG_FLOWS}), g AS (SELECT feature, avg(v) AS overall FROM l GROUP BY 1),
    c AS (SELECT cluster, feature, avg(v) AS mean FROM l GROUP BY 1, 2), x AS (SELECT cluster, feature, mean, abs(mean - overall) AS gap FROM c JOIN g USING (feature))
    SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY gap DESC, feature) AS INTEGER) AS rank, feature, round(mean, 6) AS mean, round(gap, 6) AS gap FROM x
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY gap DESC, feature) <= 3""",
)
def agg_cluster_profile(t: Tables):
    li = t.lineitem.withColumnRenamed("l_returnflag", "cluster")
    return cluster.cluster_profile(li, FLOW_FEATURES, "cluster", 3).select("cluster", "rank", "feature", r("mean"), r("gap"))


@query(
    "agg_ari_nmi",
    """WITH c AS (SELECT user_id % 4 AS a, event_type AS b, count(*)::DOUBLE AS o FROM events GROUP BY 1, 2),
    ma AS (SELECT a, sum(o) AS m FROM c GROUP BY 1), mb AS (SELECT b, sum(o) AS m FROM c GROUP BY 1),
    s AS (SELECT (SELECT sum(o) FROM c) AS n, (SELECT sum(o * (o - 1) / 2) FROM c) AS pij, (SELECT sum(m * (m - 1) / 2) FROM ma) AS pa, (SELECT sum(m * (m - 1) / 2) FROM mb) AS pb),
    h AS (SELECT -(SELECT sum(m / n * ln(m / n)) FROM ma) AS ha, -(SELECT sum(m / n * ln(m / n)) FROM mb) AS hb,
      (SELECT sum(o / n * ln(o * n / (ma.m * mb.m))) FROM c JOIN ma USING (a) JOIN mb USING (b)) AS mi FROM s)
    SELECT round((pij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM s, h""",
)
def agg_ari_nmi(t: Tables):
    return cluster.agreement(t.events.withColumn("a", F.col("user_id") % 4), "a", "event_type").select(r("ari"), r("nmi"))


@query(
    "agg_packet_protocols",
    "SELECT CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' ELSE 'other' END AS protocol, count(*) AS n FROM events GROUP BY 1",
)
def agg_packet_protocols(t: Tables):
    return packets.protocol_counts(packet_table(t))


@query(
    "agg_feature_row",
    f"""WITH {BUCKETED}, {FIRED} SELECT bucket, (n_viols > 0)::INT::DOUBLE AS rule_flagged, n_viols::DOUBLE AS rule_n_viols,
    1.0::DOUBLE AS "rule_C1_conf", 0.85::DOUBLE AS "rule_C2_conf", 0.95::DOUBLE AS "rule_C3_conf", coalesce(list_contains(ids, 'C1'), false)::INT::DOUBLE AS "rule_C1_flag",
    coalesce(list_contains(ids, 'C2'), false)::INT::DOUBLE AS "rule_C2_flag", coalesce(list_contains(ids, 'C3'), false)::INT::DOUBLE AS "rule_C3_flag" FROM fired""",
)
def agg_feature_row(t: Tables):
    return constraints.feature_row(sample_results(t), ["bucket"], IDS)


@query(
    "agg_flag_reason",
    f"WITH {BUCKETED}, {FIRED} SELECT bucket, CASE WHEN len(ids) > 0 THEN array_to_string(ids, '+') ELSE 'clean' END AS flag_reason FROM fired",
)
def agg_flag_reason(t: Tables):
    return sample_results(t).select("bucket", "flag_reason")
