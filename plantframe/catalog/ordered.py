"""Window functions, sorts, limits, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ordered import carry_forward, cooldown, previous_row, row_ordinal, segments
from ..operators import baseline, cluster, constraints, packets, profile, rolling, sampling
from .aggregates import LONG_FLOWS, SCORES, VIOL, sample_violations, scored_windows
from .base import BUCKETED, FLOW_FEATURES, READINGS, WINDOWS, Tables, query, r
from .joins import SEG, labelled_rows
from .projections import packet_table

DAY = 86_400



def rolled_sql(seconds: int) -> str:
    return f"""rolled AS (SELECT *, count(value) OVER w AS n_window, var_pop(value) OVER w AS rolling_var FROM readings
    WINDOW w AS (PARTITION BY series, sensor ORDER BY t_us RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW))"""


ROLLED = rolled_sql(DAY)


@query(
    "win_rolling_var",
    f"WITH {READINGS}, {ROLLED} SELECT row_id, n_window, CASE WHEN n_window >= 3 THEN round(sqrt(rolling_var), 6) END AS rolling_std FROM rolled",
)
def win_rolling_var(t: Tables):
    rolled = rolling.rolling_variance(t.readings, ["series", "sensor"], "t_us", DAY)
    return rolled.select("row_id", "n_window", r(F.when(F.col("n_window") >= 3, F.sqrt("rolling_var")), 6, "rolling_std"))


@query(
    "win_abs_delta",
    f"""WITH {READINGS} SELECT row_id, round(abs(value - lag(value) OVER (PARTITION BY series, sensor ORDER BY t_us, row_id)), 6) AS step FROM readings WHERE value IS NOT NULL""",
)
def win_abs_delta(t: Tables):
    known = t.readings.filter("value IS NOT NULL")
    stepped = previous_row(known, ["series", "sensor"], "t_us", "row_id", ["value"], 6 * 3600)
    return stepped.select("row_id", r(F.abs(F.col("value") - F.col("prev_value")), 6, "step"))


@query(
    "win_first_last_delta",
    f"""WITH {BUCKETED} SELECT series, sensor, bucket, round(abs(arg_max(value, t_us) - arg_min(value, t_us)), 6) AS delta,
      round(max(step), 6) AS max_step FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY series, sensor, bucket ORDER BY t_us, row_id)) AS step FROM bucketed) GROUP BY 1, 2, 3""",
)
def win_first_last_delta(t: Tables):
    keys = ["series", "bucket"]
    stats = constraints.window_stats(t.bucketed, keys)
    steps = constraints.window_steps(t.bucketed, keys, 3600)
    return stats.join(steps, [*keys, "tag"]).select(
        "series", F.col("tag").alias("sensor"), "bucket", r(F.abs(F.col("last_value") - F.col("first_value")), 6, "delta"), r("max_step")
    )


@query("win_segments", f"WITH {SEG} SELECT k, s AS start_ord, e AS end_ord FROM tseg")
def win_segments(t: Tables):
    return segments(labelled_rows(t), ["k"], "t_us", "event_id", "truth", DAY).select("k", "start_ord", "end_ord")


COOLED = """cand AS (SELECT series, sensor, t_us, min(row_id) AS row_id FROM readings WHERE value > 60 GROUP BY 1, 2, 3),
  nxt AS (SELECT *, min(t_us) OVER (PARTITION BY series, sensor ORDER BY t_us RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_t FROM cand),
  kept AS (SELECT series, sensor, min(t_us) AS t_us FROM cand GROUP BY 1, 2
    UNION ALL SELECT k.series, k.sensor, n.next_t FROM kept k JOIN nxt n ON n.series = k.series AND n.sensor = k.sensor AND n.t_us = k.t_us WHERE n.next_t IS NOT NULL)"""


@query(
    "win_cooldown",
    f"WITH RECURSIVE {READINGS}, {COOLED} SELECT row_id FROM kept JOIN cand USING (series, sensor, t_us)",
)
def win_cooldown(t: Tables):
    return cooldown(t.readings.filter("value > 60"), ["series", "sensor"], "t_us", "row_id", 3600).select("row_id")


@query(
    "win_first_detection",
    f"WITH {WINDOWS}, {SCORES} SELECT win_id, detected, latency_s FROM scores",
)
def win_first_detection(t: Tables):
    return scored_windows(t).select("win_id", "detected", "latency_s")


@query(
    "win_warmup_split",
    f"""WITH {READINGS} SELECT series, row_id FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t_us, row_id) AS rn, count(*) OVER (PARTITION BY series) AS n FROM readings)
    WHERE rn <= greatest(10, floor(0.15 * n))""",
)
def win_warmup_split(t: Tables):
    return baseline.warmup_rows(t.readings, ["series"], 0.15, DAY).select("series", "row_id")


@query(
    "win_ffill",
    f"""WITH {READINGS} SELECT row_id, last_value(CASE WHEN value > 100 THEN value END IGNORE NULLS) OVER (PARTITION BY series, sensor ORDER BY t_us, row_id ROWS UNBOUNDED PRECEDING) AS filled FROM readings""",
)
def win_ffill(t: Tables):
    holed = t.readings.withColumn("seen", F.when(F.col("value") > 100, F.col("value")))
    return carry_forward(holed, ["series", "sensor"], "t_us", "row_id", "seen", 6 * 3600, "filled").select("row_id", "filled")


KNEE = """curve AS (SELECT event_id, value AS d, row_number() OVER (ORDER BY value DESC, event_id) AS i, count(*) OVER () AS n
    FROM (SELECT * FROM events ORDER BY md5(concat_ws('|', event_id, '42')) LIMIT 5000)),
  g1 AS (SELECT *, CASE WHEN i = 1 THEN lead(d) OVER o - d WHEN i = n THEN d - lag(d) OVER o ELSE (lead(d) OVER o - lag(d) OVER o) / 2 END AS d1 FROM curve WINDOW o AS (ORDER BY i)),
  g2 AS (SELECT *, CASE WHEN i = 1 THEN lead(d1) OVER o - d1 WHEN i = n THEN d1 - lag(d1) OVER o ELSE (lead(d1) OVER o - lag(d1) OVER o) / 2 END AS d2 FROM g1 WINDOW o AS (ORDER BY i))"""


@query("win_knee", f"WITH {KNEE} SELECT d AS eps FROM g2 WHERE i <= n // 2 ORDER BY d2 DESC, i LIMIT 1")
def win_knee(t: Tables):
    sample = sampling.fixed_size(t.events, ["event_id"], 5000)
    return cluster.knee(sample, "value", "event_id")


@query(
    "win_cumulative_variance",
    f"""WITH v AS (SELECT feature, var_samp(v) AS var FROM {LONG_FLOWS} GROUP BY 1),
    o AS (SELECT CAST(row_number() OVER (ORDER BY ln(var) DESC) AS INTEGER) AS component, ln(1 + var) / sum(ln(1 + var)) OVER () AS explained FROM v),
    c AS (SELECT component, explained, sum(explained) OVER (ORDER BY component) AS cumulative FROM o)
    SELECT component, round(explained, 6) AS explained, round(cumulative, 6) AS cumulative, (SELECT min(component) FROM c WHERE cumulative >= 0.95) AS n_needed FROM c""",
)
def win_cumulative_variance(t: Tables):
    v = profile.top_variance(t.lineitem, FLOW_FEATURES)
    size = F.log1p("variance")
    shares = v.select(
        F.row_number().over(Window.orderBy(F.desc("variance"))).alias("component"),
        (size / F.sum(size).over(Window.partitionBy())).alias("explained"),
    )
    return cluster.cumulative_share(shares).select("component", r("explained"), r("cumulative"), "n_needed")


PACKETS = """pk AS (SELECT event_id, epoch_us(ts) AS t_us, CAST(user_id % 7 AS VARCHAR) AS conn, event_id * 31 % 64 AS txid FROM events)"""


@query(
    "win_txid_reuse",
    f"""WITH {PACKETS} SELECT event_id, round(gap / 1e6, 6) AS gap_s FROM (SELECT *, t_us - lag(t_us) OVER (PARTITION BY conn, txid ORDER BY t_us, event_id) AS gap FROM pk) WHERE gap <= 86400000000""",
)
def win_txid_reuse(t: Tables):
    return packets.id_reuse(packet_table(t), "conn", "txid", "t_us", "event_id", DAY, DAY).select("event_id", r("gap_s"))


@query(
    "win_payload_reuse",
    """SELECT doc_id, count(*) OVER (PARTITION BY source, md5(text)) AS n_copies, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1 AS seen_before FROM documents""",
)
def win_payload_reuse(t: Tables):
    d = t.documents.select("doc_id", "source", "text")
    return packets.payload_reuse(d, "source", "text", ["doc_id"]).select("doc_id", "n_copies", "seen_before")


@query(
    "win_timing_regularity",
    f"""WITH {PACKETS} SELECT conn, count(gap) AS n_gaps, round(avg(gap), 5) AS mean_gap_s, round(stddev_samp(gap) / avg(gap), 6) AS irregularity
    FROM (SELECT conn, (t_us - lag(t_us) OVER (PARTITION BY conn ORDER BY t_us, event_id)) / 1e6 AS gap FROM pk) GROUP BY 1""",
)
def win_timing_regularity(t: Tables):
    p = packets.timing_regularity(packet_table(t), "conn", "t_us", "event_id", DAY)
    return p.select("conn", "n_gaps", r("mean_gap_s", 5), r("irregularity"))


@query("top_features", f"SELECT feature, round(skewness(v), 5) AS skew FROM {LONG_FLOWS} GROUP BY 1 ORDER BY abs(skewness(v)) DESC, 1 LIMIT 2")
def top_features(t: Tables):
    s = profile.skew(t.lineitem, FLOW_FEATURES, -1.0)
    return s.orderBy(F.desc(F.abs("skew")), "feature").limit(2).select("feature", r("skew", 5))


@query("top_values", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(t: Tables):
    return profile.top_values(t.lineitem, "l_suppkey")


@query(
    "sort_time",
    f"""WITH {READINGS} SELECT row_id, row_number() OVER (PARTITION BY series, sensor ORDER BY t_us, row_id) - 1 AS ord FROM readings""",
)
def sort_time(t: Tables):
    return row_ordinal(t.readings, ["series", "sensor"], "t_us", "row_id", DAY).select("row_id", "ord")


@query(
    "limit_packets",
    "SELECT event_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 1000) WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 5",
)
def limit_packets(t: Tables):
    return packets.first_with_payload(packet_table(t), "t_us", "event_id", "payload_hex").select("event_id")


@query("limit_violations", f"WITH {BUCKETED}, {VIOL} SELECT bucket, constraint_id FROM viol ORDER BY 1, 2 LIMIT 5")
def limit_violations(t: Tables):
    return sample_violations(t).orderBy("bucket", "constraint_id").limit(5)


@query(
    "sample_stratified",
    "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', event_id, '42'))) <= 5",
)
def sample_stratified(t: Tables):
    return sampling.per_class(t.events, "event_type", ["event_id"], 5).select("event_id", "event_type")


@query("sample_uniform", "SELECT event_id FROM events ORDER BY md5(concat_ws('|', event_id, '42')) LIMIT 500")
def sample_uniform(t: Tables):
    return sampling.fixed_size(t.events, ["event_id"], 500).select("event_id")


@query(
    "split_stratified",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', event_id, '42'))) <= floor(0.25 * count(*) OVER (PARTITION BY event_type)) AS held_out FROM events""",
)
def split_stratified(t: Tables):
    return sampling.stratified_split(t.events, "event_type", ["event_id"]).select("event_id", "held_out")
