"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ordered import segments
from ..functions.ranks import exact_percentile
from ..operators import align, cluster, intervals, specs
from ..operators.rolling import COLLAPSE, promote
from ..operators.sampling import fixed_size
from .base import BUCKETED, FLOWS, READINGS, WINDOWS, Tables, query, r

SPREAD = """orders_day AS (
  SELECT epoch_us(o_orderdate) // 86400000000 * 86400 AS bucket, var_samp(o_totalprice) AS var_price,
         max(o_totalprice) - min(o_totalprice) AS range_price FROM orders GROUP BY 1)"""


def order_days(t: Tables):
    """Statistics of the orders per day: the second layer of the fusion queries."""
    o = t.orders
    long = o.select(
        C.time_bucket(C.epoch_us(o, "o_orderdate"), 86400).alias("bucket"), F.lit("price").alias("sensor"),
        F.col("o_totalprice").alias("value"),
    )
    return align.bucket_spread(long, ["bucket"]).select(
        "bucket", F.col("var").alias("var_price"), F.col("range").alias("range_price")
    )


def flow_days(t: Tables):
    return t.flows.withColumn("bucket", C.time_bucket(F.col("t_us"), 86400))


@query(
    "join_bucket_fuse",
    f"""WITH {FLOWS}, {SPREAD}, joined AS (
      SELECT flow_id, l_quantity, bucket, var_price, range_price
      FROM (SELECT *, t_us // 86400000000 * 86400 AS bucket FROM flows) LEFT JOIN orders_day USING (bucket))
    SELECT flow_id, l_quantity, round(coalesce(var_price, (SELECT median(var_price) FROM joined)), 0) AS var_price,
      round(coalesce(range_price, (SELECT median(range_price) FROM joined)), 2) AS range_price FROM joined""",
)
def join_bucket_fuse(t: Tables):
    fused = align.fuse(flow_days(t), order_days(t), ["bucket"])
    return fused.select("flow_id", "l_quantity", r("var_price", 0), r("range_price", 2))


@query(
    "join_coverage",
    f"""WITH {FLOWS}, b AS (SELECT DISTINCT epoch_us(o_orderdate) // 86400000000 * 86400 AS bucket FROM orders)
    SELECT off_days, CAST(count(*) AS BIGINT) AS n_flows, CAST(sum(CASE WHEN k IN (SELECT bucket FROM b) THEN 1 ELSE 0 END) AS BIGINT) AS n_matched,
      round(avg(CASE WHEN k IN (SELECT bucket FROM b) THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM (SELECT off_days, (t_us // 86400000000 + off_days) * 86400 AS k FROM flows, (VALUES (0), (-400)) v(off_days)) GROUP BY 1""",
)
def join_coverage(t: Tables):
    days = order_days(t)
    parts = [
        align.coverage(t.flows, C.time_bucket(C.shift_clock(F.col("t_us"), d * 86400), 86400), days, "bucket").withColumn("off_days", F.lit(d))
        for d in (0, -400)
    ]
    return parts[0].unionByName(parts[1]).select("off_days", "n_flows", "n_matched", r("coverage"))


@query(
    "join_count_lookup",
    f"""WITH {BUCKETED} SELECT a.bucket, coalesce(n, 0) AS n_flows FROM (SELECT DISTINCT bucket FROM bucketed WHERE series = '0') a
    LEFT JOIN (SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM bucketed WHERE series = '1' AND value > 150 GROUP BY 1) b USING (bucket)""",
)
def join_count_lookup(t: Tables):
    b = t.bucketed
    counts = b.filter("series = '1' AND value > 150").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_flows"))
    return align.with_count(b.filter("series = '0'").select("bucket").distinct(), counts, ["bucket"], "n_flows")


@query(
    "join_point_in_window",
    f"""WITH {WINDOWS} SELECT win_id, attack, CAST(count(row_id) AS BIGINT) AS n, round(coalesce(max(value), 0), 6) AS top
    FROM windows LEFT JOIN (SELECT * FROM readings WHERE value > 100) ON t_us BETWEEN start_us AND end_us GROUP BY 1, 2""",
)
def join_point_in_window(t: Tables):
    w = t.windows
    hits = intervals.points_in_windows(t.readings.filter("value > 100"), "t_us", w, "start_us", "end_us", 6 * 3600)
    per = hits.groupBy("win_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    kept = intervals.keep_all_windows(w, ["win_id"], per, {"n": 0, "top": 0.0})
    return kept.select("win_id", "attack", "n", r("top"))


@query(
    "join_bucket_in_window",
    f"""WITH {WINDOWS}, b AS (SELECT DISTINCT t_us // 3600000000 * 3600 AS bucket FROM readings)
    SELECT win_id, CAST(count(bucket) AS BIGINT) AS n_windows FROM windows
    LEFT JOIN b ON bucket * 1000000 BETWEEN start_us AND end_us GROUP BY 1""",
)
def join_bucket_in_window(t: Tables):
    b = t.readings.select(C.time_bucket(F.col("t_us"), 3600).alias("bucket")).distinct().withColumn("b_us", F.col("bucket") * C.MICROS)
    w = t.windows
    per = intervals.points_in_windows(b, "b_us", w, "start_us", "end_us", 3600).groupBy("win_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return intervals.keep_all_windows(w.select("win_id"), ["win_id"], per, {"n_windows": 0})


OVERLAP_LABEL = """labelled AS (
  SELECT bucket, coalesce(attack, 'Normal') AS true_label, coalesce(share, 0) AS share
  FROM (SELECT DISTINCT t_us // 3600000000 * 3600 AS bucket FROM readings) LEFT JOIN (
    SELECT bucket, attack, (least((bucket + 3600) * 1000000, end_us) - greatest(bucket * 1000000, start_us)) / 3600e6 AS share
    FROM (SELECT DISTINCT t_us // 3600000000 * 3600 AS bucket FROM readings)
    JOIN windows ON end_us >= bucket * 1000000 AND start_us < (bucket + 3600) * 1000000
    WHERE (least((bucket + 3600) * 1000000, end_us) - greatest(bucket * 1000000, start_us)) / 3600e6 > 0.3
    QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY least((bucket + 3600) * 1000000, end_us) - greatest(bucket * 1000000, start_us) DESC, win_id) = 1) USING (bucket))"""


@query("join_overlap_best", f"WITH {WINDOWS}, {OVERLAP_LABEL} SELECT bucket, true_label, round(share, 6) AS share FROM labelled")
def join_overlap_best(t: Tables):
    b = t.readings.select(C.time_bucket(F.col("t_us"), 3600).alias("bucket")).distinct()
    best = intervals.best_overlap(b, "bucket", 3600, t.windows, "start_us", "end_us", "attack", "win_id")
    return best.select("bucket", "true_label", r("share"))


@query(
    "join_label_span",
    f"""WITH {WINDOWS}, spans AS (SELECT attack, min(start_us) AS s, max(end_us) AS e FROM windows GROUP BY 1)
    SELECT row_id, coalesce((SELECT arg_max(attack, list_position(['replay','ddos','port-scan','mitm','ip-scan'], attack))
      FROM spans WHERE t_us BETWEEN s AND e), 'Normal') AS label FROM readings""",
)
def join_label_span(t: Tables):
    return intervals.label_by_span(t.readings, "t_us", t.windows, "attack", "start_us", "end_us").select("row_id", "label")


@query(
    "join_split_by_window",
    f"""WITH {WINDOWS}, f AS (SELECT arg_min(start_us, start_us) AS s, arg_min(end_us, start_us) AS e FROM windows)
    SELECT row_id, CASE WHEN t_us < (SELECT s FROM f) THEN 'before' WHEN t_us <= (SELECT e FROM f) THEN 'inside' END AS part FROM readings""",
)
def join_split_by_window(t: Tables):
    return intervals.split_by_first_window(t.readings, "t_us", t.windows, "start_us", "end_us").select("row_id", "part")


@query(
    "join_windows_in_range",
    f"""WITH {WINDOWS} SELECT win_id FROM windows WHERE start_us BETWEEN (SELECT min(t_us) FROM readings WHERE value > 300)
    AND (SELECT max(t_us) FROM readings WHERE value > 300)""",
)
def join_windows_in_range(t: Tables):
    return intervals.windows_in_range(t.windows, "start_us", t.readings.filter("value > 300"), "t_us").select("win_id")


@query(
    "join_self_range_count",
    f"""WITH {READINGS}, a AS (SELECT *, CASE WHEN value < 5 THEN 'variance_collapse' ELSE 'z_score_spike' END AS kind
      FROM readings WHERE value < 5 OR value > 150)
    SELECT row_id, CASE WHEN kind = 'variance_collapse' AND count(*) FILTER (kind = 'variance_collapse') OVER (
      PARTITION BY series ORDER BY t_us RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING) >= 3
      THEN 'cross_layer' ELSE kind END AS alert_type FROM a""",
)
def join_self_range_count(t: Tables):
    kind = F.when(F.col("value") < 5, COLLAPSE).otherwise("z_score_spike")
    a = t.readings.filter("value < 5 OR value > 150").withColumn("alert_type", kind)
    return promote(a, "series", 1800).select("row_id", "alert_type")


SEG = """lab AS (SELECT user_id AS k, epoch_us(ts) AS t_us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
    event_type = 'error' AS truth, value > 60 AS flagged FROM events),
  tseg AS (SELECT k, min(ord) AS s, max(ord) AS e FROM (SELECT k, ord, ord - row_number() OVER (PARTITION BY k ORDER BY ord) AS g FROM lab WHERE truth) GROUP BY k, g),
  pseg AS (SELECT k, min(ord) AS s, max(ord) AS e FROM (SELECT k, ord, ord - row_number() OVER (PARTITION BY k ORDER BY ord) AS g FROM lab WHERE flagged) GROUP BY k, g)"""


def labelled_rows(t: Tables):
    e = t.events
    return e.select(
        F.col("user_id").alias("k"), C.epoch_us(e, "ts").alias("t_us"), "event_id",
        (F.col("event_type") == "error").alias("truth"), (F.col("value") > 60).alias("flagged"),
    )


@query(
    "join_segment_overlap",
    f"""WITH {SEG} SELECT k, s AS start_ord, e AS end_ord FROM tseg
    WHERE EXISTS (SELECT 1 FROM pseg p WHERE p.k = tseg.k AND p.e >= greatest(0, tseg.s - 2) AND p.s <= tseg.e)""",
)
def join_segment_overlap(t: Tables):
    rows = labelled_rows(t)
    truth = segments(rows, ["k"], "t_us", "event_id", "truth", 86400)
    found = segments(rows, ["k"], "t_us", "event_id", "flagged", 86400)
    return intervals.overlapping(truth, found, ["k"], 2, 0)


LIMITS = """limits AS (SELECT event_type AS tag, 0.0::DOUBLE AS min_val, quantile_cont(value, 0.99) AS max_val FROM events GROUP BY 1)"""


@query(
    "join_spec_windows",
    f"""WITH {BUCKETED}, {LIMITS} SELECT series, bucket, sensor AS tag, round(min(value), 6) AS lo, round(max(value), 6) AS hi,
      round(any_value(max_val), 6) AS max_val FROM bucketed JOIN limits ON tag = sensor GROUP BY 1, 2, 3""",
)
def join_spec_windows(t: Tables):
    limits = exact_percentile(t.readings, ["sensor"], "value", 0.99, "max_val").withColumnRenamed("sensor", "tag")
    stats = t.bucketed.groupBy("series", "bucket", F.col("sensor").alias("tag")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return stats.join(limits, "tag").select("series", "bucket", "tag", r("lo"), r("hi"), r("max_val"))


SPECS = """sa AS (SELECT 'u' || user_id AS tag, 0.0::DOUBLE AS min_val, ceil(max(value)) AS max_val, bool_or(value > 200) AS lim FROM events WHERE ts < TIMESTAMP '2024-01-16' AND user_id % 7 <> 0 GROUP BY user_id),
  sb AS (SELECT 'u' || user_id AS tag, CASE WHEN user_id % 10 = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS min_val, ceil(max(value)) AS max_val, bool_or(value > 200) AS lim FROM events WHERE user_id % 5 <> 0 GROUP BY user_id)"""


def two_specs(t: Tables):
    tag = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag")
    stats = [F.ceil(F.max("value")).cast("double").alias("max_val"), F.max(F.col("value") > 200).alias("has_rate_limiter")]
    a = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-16' AND user_id % 7 <> 0").groupBy(tag, "user_id").agg(*stats)
    b = t.events.filter("user_id % 5 <> 0").groupBy(tag, "user_id").agg(*stats)
    low = F.when(F.col("user_id") % 10 == 3, 1.0).otherwise(0.0).alias("min_val")
    return (
        a.select("tag", F.lit(0.0).alias("min_val"), "max_val", "has_rate_limiter", F.col("tag").alias("loop_id")),
        b.select("tag", low, "max_val", "has_rate_limiter", F.col("tag").alias("loop_id")),
    )


@query(
    "join_spec_diff",
    f"""WITH {SPECS}, d AS (SELECT a.tag AS ta, b.tag AS tb, a.min_val <> b.min_val OR a.max_val <> b.max_val AS wrong, a.lim = b.lim AS same FROM sa a FULL JOIN sb b ON a.tag = b.tag)
    SELECT count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS n_common, count(ta) AS n_expected, count(*) FILTER (tb IS NULL) AS n_missing,
      count(*) FILTER (ta IS NULL) AS n_extra, count(*) FILTER (wrong) AS n_bound_errors,
      round(count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) / count(ta)::DOUBLE, 3) AS coverage,
      count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS n_loops_common, count(*) FILTER (same) AS n_limiters_right FROM d""",
)
def join_spec_diff(t: Tables):
    a, b = two_specs(t)
    return specs.compare_specs(a, b, a, b)


@query("set_union", "SELECT event_id AS id, value AS x FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE value > 100")
def set_union(t: Tables):
    e = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("x"), "user_id")
    return e.filter("user_id % 2 = 0").drop("user_id").unionByName(e.filter("x > 100").drop("user_id"))


@query("set_intersect", f"WITH {SPECS} SELECT tag FROM sa INTERSECT SELECT tag FROM sb")
def set_intersect(t: Tables):
    a, b = two_specs(t)
    return a.select("tag").intersect(b.select("tag"))


@query(
    "set_except",
    f"WITH {SPECS} SELECT tag, 'missing' AS side FROM sa ANTI JOIN sb USING (tag) UNION ALL SELECT tag, 'extra' FROM sb ANTI JOIN sa USING (tag)",
)
def set_except(t: Tables):
    a, b = two_specs(t)
    missing = a.select("tag").exceptAll(b.select("tag")).withColumn("side", F.lit("missing"))
    return missing.unionByName(b.select("tag").exceptAll(a.select("tag")).withColumn("side", F.lit("extra")))


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


SAMPLE = """s AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings ORDER BY md5(concat_ws('|', vec_id, '42')) LIMIT {n})"""
PAIRS = """pairs AS (SELECT a.vec_id, s.label, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], s.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM embeddings a, s)"""


@query(
    "join_knn_distance",
    f"""WITH {SAMPLE.format(n=5000)}, {PAIRS} SELECT vec_id AS row_id, round(d, 5) AS knn_distance FROM pairs
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 4""",
)
def join_knn_distance(t: Tables):
    v = vectors(t)
    scored = cluster.neighbour_distance(v, "x", fixed_size(v, ["row_id"], 5000), 4)
    return scored.select("row_id", r("knn_distance", 5))


@query(
    "join_knn1_assign",
    f"WITH {SAMPLE.format(n=5000)}, {PAIRS} SELECT vec_id AS row_id, CAST(arg_min(label, d) AS BIGINT) AS cluster FROM pairs GROUP BY 1",
)
def join_knn1_assign(t: Tables):
    v = vectors(t)
    return cluster.nearest_label(v, "x", fixed_size(v, ["row_id"], 5000), "label").select("row_id", "cluster")
