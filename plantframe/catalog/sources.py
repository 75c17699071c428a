"""Readers and sinks. What a reader reads is first written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import MICROS, epoch_us
from ..session import scratch_path
from ..sources import readers, sinks
from ..sources.specs import load_specs, parse_spec_json
from .base import FLOWS, READINGS, SENSORS, WINDOWS, Tables, query, r


def _text_time(us: str):
    return F.expr(f"string(timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ '1970-01-01 00:00:00'))")


@query(
    "src_flows",
    f"""WITH {FLOWS} SELECT flow_id AS "sAddress", l_returnflag AS "IT_M_Label", round(t_us / 1e6, 3) AS start,
    l_quantity AS duration, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_extendedprice END AS "sBytesSum" FROM flows""",
)
def src_flows(t: Tables):
    path = scratch_path(t.spark, "flows")
    wide = t.flows.select(
        F.col("l_linestatus").alias("_part"), F.col("flow_id").alias(" sAddress"), F.col("l_returnflag").alias(" IT_M_Label"),
        (F.col("t_us") / MICROS).alias("start"), F.col("l_quantity").alias("duration "),
        F.when(F.col("l_linestatus") == "O", F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string")).alias("sBytesSum"),
    )
    # two sets of files that order their columns differently
    names = [c for c in wide.columns if c != "_part"]
    wide.filter("_part = 'O'").select(*[F.col(c) for c in names]).write.option("header", True).csv(path)
    wide.filter("_part <> 'O'").select(*[F.col(c) for c in reversed(names)]).write.mode("append").option("header", True).csv(path)
    return readers.read_flows(t.spark, path).select(
        "sAddress", "IT_M_Label", r("start", 3), "duration", "sBytesSum"
    )


_BY_SENSOR = ", ".join(f"""CASE WHEN sensor = '{s}' THEN value END AS "{s}\"""" for s in SENSORS)


@query(
    "src_snapshots",
    f"""WITH {READINGS} SELECT t_us // 1000000 AS unix_ts, round((t_us - min(t_us) OVER (PARTITION BY series)) / 1e6, 6) AS elapsed_s,
    series, {_BY_SENSOR} FROM readings WHERE value IS NULL OR value <= 100""",
)
def src_snapshots(t: Tables):
    """Both controllers; rows of very large values are written without a time, and readers leave such rows out."""
    parts = []
    for series in ("0", "1"):
        path = scratch_path(t.spark, "snapshots")
        t.readings.filter(F.col("series") == series).select(
            F.when(F.col("value") > 100, "not a time").otherwise(_text_time("t_us")).alias("time"),
            *[F.when(F.col("sensor") == s, F.col("value")).alias(f" {s}") for s in SENSORS],
        ).write.option("header", True).csv(path)
        parts.append(readers.read_snapshots(t.spark, path, [*SENSORS, "absent"], series))
    return parts[0].unionByName(parts[1]).select("unix_ts", r("elapsed_s"), "series", *SENSORS)


@query(
    "src_attack_windows",
    f"WITH {WINDOWS} SELECT attack, start_us, end_us, round(start_us / 1e6 - 7200, 3) AS start_stamp FROM windows",
)
def src_attack_windows(t: Tables):
    path = scratch_path(t.spark, "attacks")
    stamp = lambda c: F.format_string("%.6f", F.col(c) / MICROS - 7200)
    t.windows.select(
        "attack", stamp("start_us").alias("startStamp"), stamp("end_us").alias("endStamp"),
        _text_time("start_us").alias("startTime"), _text_time("end_us").alias("endTime"),
        F.lit("aa:bb").alias("attackerMAC"), F.lit("10.0.0.1").alias("attackerIP"), F.lit("").alias("description"),
    ).write.option("header", True).csv(path)
    return readers.read_attack_windows(t.spark, path).select(
        "attack", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), r("start_stamp", 3)
    )


def _tagged_files(t: Tables) -> str:
    """Two files of one role with different headers, and one of the other role."""
    folder = scratch_path(t.spark, "tagged")
    e = t.readings.select(
        _text_time("t_us").alias("timestamp"), (F.col("sensor") == "error").cast("int").alias("attack"), "series", "sensor", "value"
    )
    one = e.filter("sensor <> 'view'").select("timestamp", F.col("value").alias("P1_FIT01"), "attack")
    two = e.filter("sensor = 'view'").select(
        F.col("timestamp").alias("Time"), F.col("value").alias("P1_FIT01"), F.lit(1.5).alias("P2_SCO")
    )
    for df, name in ((one, "train1.csv"), (two, "train2.csv"), (one, "test1.csv")):
        df.write.option("header", True).csv(f"{folder}/{name}")
    return folder


@query(
    "src_multi_file",
    f"""WITH {READINGS} SELECT t_us, CAST(CASE WHEN sensor = 'error' THEN 1 ELSE 0 END AS INTEGER) AS attack, value AS "P1_FIT01",
    CASE WHEN sensor = 'view' THEN 1.5 END AS "P2_SCO" FROM readings""",
)
def src_multi_file(t: Tables):
    both = readers.read_tagged(t.spark, _tagged_files(t), "train", ["P1_FIT01", "P2_SCO"])
    return both.select(F.unix_micros("ts").alias("t_us"), "attack", "P1_FIT01", "P2_SCO")


@query(
    "src_resolve_columns",
    "SELECT epoch_us(ts) AS t_us, CAST(0 AS INTEGER) AS attack, event_id, value FROM events",
)
def src_resolve_columns(t: Tables):
    renamed = t.events.select(F.col("ts").alias("Timestamp"), "event_id", "value")
    ready = readers.resolve_columns(renamed)
    return ready.select(F.unix_micros("ts").alias("t_us"), "attack", "event_id", "value")


def stream_of_readings(t: Tables):
    """The events table as a stream of readings."""
    schema = t.events.schema
    raw = readers.stream_readings(t.spark, t.folder, schema=schema, name_filter="events.parquet")
    return raw.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % 2).cast("string").alias("series"),
        F.col("event_type").alias("sensor"), F.timestamp_micros(epoch_us(raw, "ts")).alias("ts"), "value",
    )


def run_stream(t: Tables, df, label: str):
    """Run a stream over what is there into a table and read the table."""
    out, mark = scratch_path(t.spark, label), scratch_path(t.spark, label + "-checkpoint")
    started = sinks.write_stream(df, out, mark, once=True)
    started.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("src_stream", f"WITH {READINGS} SELECT row_id, series, sensor, value FROM readings")
def src_stream(t: Tables):
    return run_stream(t, stream_of_readings(t), "readings").select("row_id", "series", "sensor", "value")


SPEC_RANGE = """spec AS (
  SELECT 'plant-' || CAST(user_id % 10 AS VARCHAR) AS spec_name, event_type AS tag,
         min(value) AS min_val, max(value) AS max_val, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def spec_ranges(t: Tables):
    """Limits of each sensor of ten plants, taken from the readings."""
    return t.events.groupBy(
        F.concat(F.lit("plant-"), (F.col("user_id") % 10).cast("string")).alias("spec_name"),
        F.col("event_type").alias("tag"),
    ).agg(F.min("value").alias("min_val"), F.max("value").alias("max_val"), F.count(F.lit(1)).alias("n"))


@query(
    "src_spec_tables",
    f"""WITH {SPEC_RANGE} SELECT spec_name, tag, min_val, max_val, '' AS unit,
    CAST(CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence,
    CAST(count(*) OVER (PARTITION BY spec_name) AS BIGINT) AS n_tags FROM spec""",
)
def src_spec_tables(t: Tables):
    path = scratch_path(t.spark, "specs")
    tag = F.struct(
        F.col("tag").alias("name"), "min_val", "max_val",
        F.struct(F.when(F.col("n") % 2 == 0, 0.5).alias("confidence")).alias("source"),
    )
    entries = spec_ranges(t).groupBy("spec_name").agg(F.collect_list(F.struct("tag", tag.alias("t"))).alias("e"))
    entries.select(
        F.struct(F.col("spec_name").alias("dataset_name"), F.map_from_entries("e").alias("tag_specs")).alias("spec")
    ).repartition("spec").write.option("maxRecordsPerFile", 1).json(path)
    tags, _ = load_specs(t.spark, path)
    n = tags.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n_tags"))
    return tags.join(n, "spec_name").select("spec_name", "tag", "min_val", "max_val", "unit", "confidence", "n_tags")


@query(
    "src_spec_json_column",
    f"""WITH {SPEC_RANGE} SELECT spec_name, tag, CASE WHEN n % 3 = 0 THEN 0.0::DOUBLE ELSE round(min_val, 6) END AS min_val,
    round(max_val, 6) AS max_val, 0.85::DOUBLE AS confidence FROM spec""",
)
def src_spec_json_column(t: Tables):
    item = F.to_json(
        F.struct(F.col("tag").alias("name"), F.when(F.col("n") % 3 != 0, F.col("min_val")).alias("min_val"), "max_val")
    )
    listed = spec_ranges(t).groupBy("spec_name").agg(F.array_join(F.collect_list(item), ", // next\n").alias("items"))
    text = listed.select(
        "spec_name",
        F.concat(F.lit('```json\nHere it is: {"tag_specs": [ // all tags\n'), "items", F.lit('\n], "loop_specs": []}\n```')).alias("text"),
    )
    tags, _, _ = parse_spec_json(text, "text", "spec_name")
    return tags.select("spec_name", "tag", r("min_val"), r("max_val"), "confidence")


@query(
    "sink_tables",
    f"WITH {WINDOWS} SELECT win_id, attack, start_us, end_us FROM windows",
)
def sink_tables(t: Tables):
    path = scratch_path(t.spark, "sink")
    sinks.write_table(t.windows, path, "csv")
    return t.spark.read.schema(t.windows.schema).option("header", True).csv(path)


@query(
    "sink_report",
    """SELECT CAST(count(*) AS BIGINT) AS n, round(max(value), 6) AS top,
    CAST((SELECT count(DISTINCT event_type) FROM events) AS BIGINT) AS n_sensors FROM events""",
)
def sink_report(t: Tables):
    path = scratch_path(t.spark, "report")
    totals = t.events.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    per = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report({"totals": totals, "sensors": per}, path)
    shape = "totals ARRAY<STRUCT<n: LONG, top: DOUBLE>>, sensors ARRAY<STRUCT<event_type: STRING, n: LONG>>"
    return t.spark.read.schema(shape).json(path).select(
        F.col("totals")[0]["n"].alias("n"), r(F.col("totals")[0]["top"], 6, "top"), F.size("sensors").cast("long").alias("n_sensors")
    )


@query(
    "sink_stream",
    f"WITH {READINGS} SELECT row_id, series, sensor, round(value, 6) AS value FROM readings WHERE value > 200",
)
def sink_stream(t: Tables):
    """The stream arrives in parts of one file each; the last batch comes again as after a failure."""
    parts, out, mark = (scratch_path(t.spark, label) for label in ("parts", "alerts", "alerts-checkpoint"))
    wanted = t.readings.select("row_id", "series", "sensor", "value")
    wanted.repartitionByRange(3, "row_id").write.parquet(parts)
    alerts = t.spark.readStream.schema(wanted.schema).option("maxFilesPerTrigger", 1).parquet(parts).filter("value > 200")
    sinks.write_batches(alerts, out, mark, once=True).awaitTermination()
    commits = t.spark._jvm.org.apache.hadoop.fs.Path(f"{mark}/commits")
    files = commits.getFileSystem(t.spark._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in files.listStatus(commits) if f.getPath().getName().isdigit())
    files.delete(t.spark._jvm.org.apache.hadoop.fs.Path(f"{mark}/commits/{last}"), False)
    sinks.write_batches(alerts, out, mark, once=True).awaitTermination()
    return sinks.read_batches(t.spark, out, wanted.schema).select("row_id", "series", "sensor", r("value"))
