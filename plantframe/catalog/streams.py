"""Structured Streaming queries. Each takes what is there, runs to the end and gives its table.

The SQL says what is closed: a window is given out once the watermark, the largest event time minus the
allowed delay, has passed its end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline
from ..session import scratch_path, stage
from ..sources.readers import stream_readings
from ..sources.sinks import write_stream
from ..streaming import jobs
from .aggregates import WARM_BUCKETS, tag_base, warm_readings
from .base import BUCKETED, READINGS, Tables, query, r
from .constraints import DETECT, GC, HEAD, cubed, spec_tables
from .sources import run_stream, stream_of_readings

CLOSED = "(bucket + 21600) * 1000000 <= (SELECT max(t_us) FROM readings) // 1000 * 1000 - 3600000000"


@query(
    "str_tumbling_stats",
    f"""WITH {BUCKETED} SELECT series, sensor, bucket, count(value) AS n, round(sqrt(var_samp(value)), 6) AS std, round(max(value) - min(value), 6) AS range
    FROM bucketed WHERE {CLOSED} GROUP BY 1, 2, 3""",
)
def str_tumbling_stats(t: Tables):
    out = run_stream(t, jobs.tumbling_stats(stream_of_readings(t), "6 hours", "1 hour"), "tumbling")
    return out.select("series", "sensor", jobs.window_start().alias("bucket"), "n", r(F.sqrt("var"), 6, "std"), r("range"))


@query(
    "str_sliding_var",
    f"""WITH {READINGS} SELECT series, sensor, w AS bucket, count(value) AS n, round(sqrt(var_pop(value)), 6) AS std FROM (
      SELECT *, unnest([t_us // 21600000000 * 21600, (t_us // 21600000000 - 1) * 21600, (t_us // 21600000000 - 2) * 21600, (t_us // 21600000000 - 3) * 21600]) AS w FROM readings)
    WHERE (w + 86400) * 1000000 <= (SELECT max(t_us) FROM readings) // 1000 * 1000 - 3600000000 GROUP BY 1, 2, 3""",
)
def str_sliding_var(t: Tables):
    out = run_stream(t, jobs.sliding_variance(stream_of_readings(t), "24 hours", "6 hours", "1 hour"), "sliding")
    return out.select("series", "sensor", jobs.window_start().alias("bucket"), "n", r(F.sqrt("rolling_var"), 6, "std"))


def with_micros(df):
    return df.withColumn("t_us", F.unix_micros("ts"))


def detector_alerts(t: Tables):
    base = stage(baseline.detector_baseline(warm_readings(t)), "baseline")
    alerts = jobs.detector(with_micros(stream_of_readings(t)), base, "1 hour", 7200, 3600)
    return run_stream(t, alerts, "alerts")


PASSED = "t_us <= (SELECT max(t_us) FROM readings WHERE value IS NOT NULL) // 1000 * 1000 - 3600000000"


@query(
    "str_spike_collapse",
    f"""{DETECT} SELECT row_id, series, sensor, CASE WHEN alert_type = 'cross_layer' THEN 'variance_collapse' ELSE alert_type END AS alert_type
    FROM al WHERE {PASSED}""",
)
def str_spike_collapse(t: Tables):
    return detector_alerts(t).select("row_id", "series", "sensor", "alert_type")


@query(
    "str_cross_layer",
    f"""{DETECT} SELECT row_id, series, sensor, alert_type FROM al WHERE alert_type <> 'z_score_spike'
    AND t_us + 21600000000 < ((SELECT max(t_us) FROM al WHERE alert_type <> 'z_score_spike' AND {PASSED}) // 1000 - 3600000) * 1000""",
)
def str_cross_layer(t: Tables):
    kept = detector_alerts(t)
    folder = scratch_path(t.spark, "alert-table")
    kept.write.parquet(folder)
    alerts = t.spark.readStream.schema(kept.schema).parquet(folder)
    out = run_stream(t, jobs.promoter(alerts, "1 hour", 21600), "promoted")
    return out.select("row_id", "series", "sensor", "alert_type")


@query(
    "str_constraints",
    f"""{HEAD}, {WARM_BUCKETS}, q(series, bucket, cid, what) AS ({GC["GC1"]} UNION ALL {GC["GC3"]} UNION ALL {GC["GC4"]}),
    fz AS (SELECT s.series, s.bucket, 'FROZEN' AS cid, s.tag FROM stats s JOIN wbase b ON b.series = s.series AND b.sensor = s.tag WHERE s.n >= 2 AND var < 0.05 * b.variance)
    SELECT series, bucket, cid AS constraint_id, count(*) AS n FROM (SELECT * FROM q UNION ALL SELECT * FROM fz) WHERE {CLOSED} GROUP BY 1, 2, 3""",
)
def str_constraints(t: Tables):
    tags, loops = spec_tables(t)
    rows = cubed(stream_of_readings(t))
    history = cubed(t.bucketed)
    chosen = baseline.warmup_buckets(history, ["series"], "bucket", 0.15, 5)
    usual = stage(baseline.window_baseline(history.join(chosen, ["series", "bucket"], "left_semi")), "baseline")
    by_tag = stage(tag_base(t, cubed(t.readings)), "tag-baseline")
    limits = run_stream(t, jobs.limit_violations(rows, tags, usual, "6 hours", "1 hour"), "violations")
    coupled = run_stream(t, jobs.loop_violations(rows, loops, by_tag, "6 hours", "1 hour"), "loops")
    found = limits.drop("sensor").unionByName(coupled)
    return found.groupBy("series", jobs.window_start().alias("bucket"), "constraint_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "str_fuse_layers",
    f"""WITH {BUCKETED} SELECT series, bucket, n_readings, coalesce(n_flows, 0) AS n_flows FROM (SELECT series, bucket, count(value) AS n_readings FROM bucketed WHERE {CLOSED} GROUP BY 1, 2)
    LEFT JOIN (SELECT bucket, count(*) AS n_flows FROM bucketed WHERE value > 150 GROUP BY 1) USING (bucket)
    WHERE (bucket + 21600) * 1000000 <= (SELECT max(t_us) FROM readings WHERE value > 150) // 1000 * 1000 - 3600000000""",
)
def str_fuse_layers(t: Tables):
    flows = stream_of_readings(t).filter("value > 150").select("ts")
    out = run_stream(t, jobs.fuse_layers(stream_of_readings(t), flows, "6 hours", "1 hour"), "fused")
    return out.select("series", jobs.window_start().alias("bucket"), "n_readings", "n_flows")


@query(
    "str_session_alerts",
    f"""WITH {READINGS}, a AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY series ORDER BY t_us) > 3600000000 AS gap FROM readings WHERE value > 100),
    s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY series ORDER BY t_us) AS sid FROM a)
    SELECT series, min(t_us) // 1000000 AS start_s, count(*) AS n_alerts FROM s GROUP BY series, sid
    HAVING max(t_us) + 3600000000 <= (SELECT max(t_us) FROM a) // 1000 * 1000 - 3600000000""",
)
def str_session_alerts(t: Tables):
    alerts = stream_of_readings(t).filter("value > 100")
    out = run_stream(t, jobs.alert_sessions(alerts, "1 hour", "1 hour"), "sessions")
    return out.select("series", jobs.window_start("session_window").alias("start_s"), "n_alerts")


@query(
    "str_late_data",
    f"""WITH {READINGS}, cut AS (SELECT 1705276800000000 AS c), b AS (SELECT *, t_us // 86400000000 * 86400 AS day FROM readings)
    SELECT day AS bucket, count(*) AS n FROM b, cut WHERE t_us >= c AND (day + 86400) * 1000000 <= (SELECT max(t_us) FROM readings) // 1000 * 1000 - 3600000000 GROUP BY 1""",
)
def str_late_data(t: Tables):
    """The second half of the month comes in first; the first half is then late and is dropped."""
    folder = scratch_path(t.spark, "arrivals")
    rows = t.readings.withColumn("ts", F.timestamp_micros("t_us")).select("row_id", "series", "sensor", "ts", "value")
    out, mark = scratch_path(t.spark, "late"), scratch_path(t.spark, "late-checkpoint")
    late = F.col("ts") < F.timestamp_seconds(F.lit(1705276800))
    daily = (
        lambda df: df.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    )
    for part in (~late, late):
        rows.filter(part).write.mode("append").parquet(folder)
        stream = daily(stream_readings(t.spark, folder))
        write_stream(stream, out, mark, once=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out).select(jobs.window_start().alias("bucket"), "n")
