"""A stream in several batches gives what the batch form gives."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantframe.operators import baseline, rolling
from plantframe.sources.sinks import read_batches, write_batches, write_stream
from plantframe.sources.readers import READING_SCHEMA, stream_readings
from plantframe.streaming import jobs


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(5)
    rows = []
    for sensor in ("a", "b", "c", "d"):
        for i in range(600):
            frozen = 300 <= i < 380
            v = 1.0 if frozen else rng.normal(0, 1)
            if i in (450, 453, 458, 500):
                v = 9.0
            rows.append((len(rows), "s", sensor, i * 2.0 + rng.random(), float(v)))
    df = spark.createDataFrame(rows, "row_id long, series string, sensor string, sec double, value double")
    return df.select("row_id", "series", "sensor", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")).alias("ts"), "value", F.expr("int(sec / 200)").alias("part")).persist()


def feed(spark, df, build, folder, parts):
    """Write the parts one by one and run the stream after each."""
    src, out, mark = (str(folder / n) for n in ("in", "out", "mark"))
    for p in parts:
        df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = build(stream_readings(spark, src))
        write_stream(stream, out, mark, once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def warm_baseline(readings):
    return baseline.detector_baseline(readings.filter("part < 2"))


def test_detector_in_batches_equals_the_batch_detector(spark, readings, tmp_path):
    base = warm_baseline(readings).persist()
    micros = readings.withColumn("t_us", F.unix_micros("ts"))
    rolled = rolling.rolling_variance(micros, ["series", "sensor"], "t_us", 60)
    found = rolling.candidates(rolled, base, ["series", "sensor"])
    from plantframe.functions.ordered import cooldown

    want = cooldown(found, ["series", "sensor", "alert_type"], "t_us", "row_id", 5)
    got = feed(
        spark, readings, lambda s: jobs.detector(s.withColumn("t_us", F.unix_micros("ts")), base, "10 seconds"), tmp_path, range(7)
    )
    pick = lambda df: sorted((r.row_id, r.alert_type, r.confidence) for r in df.collect())
    end = micros.agg(F.max("t_us")).first()[0]
    assert pick(got) == pick(want.filter(F.col("t_us") <= (end // 1000 - 10_000) * 1000))
    kinds = {r.alert_type for r in want.collect()}
    assert kinds == {"z_score_spike", "variance_collapse"}

    promoted = rolling.promote(want, "series", 30)
    alerts = want.withColumn("ts", F.timestamp_micros("t_us")).withColumn("part", F.expr("int(t_us / 100000000)"))
    src, out, mark = (str(tmp_path / n) for n in ("alerts", "promoted", "mark2"))
    for p in sorted(r.part for r in alerts.select("part").distinct().collect()):
        alerts.filter(F.col("part") == p).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.promoter(spark.readStream.schema(alerts.schema).parquet(src), "10 seconds")
        write_stream(stream, out, mark, once=True).awaitTermination()
    last = want.filter(F.col("alert_type") == rolling.COLLAPSE).agg(F.max("t_us")).first()[0]
    closed = promoted.filter(F.col("alert_type") != rolling.SPIKE).filter(F.col("t_us") + 30_000_000 < (last // 1000 - 10_000) * 1000)
    seen = sorted((r.row_id, r.alert_type) for r in spark.read.schema(stream.schema).parquet(out).collect())
    assert seen == sorted((r.row_id, r.alert_type) for r in closed.collect())
    assert "cross_layer" in {k for _, k in seen}


def test_detector_keeps_rows_inside_the_watermark(spark, readings, tmp_path):
    """Rows of all times in every batch, in any order, and equal instants in different batches."""
    base = warm_baseline(readings).persist()
    mixed = readings.withColumn("part", F.expr("pmod(hash(row_id), 4)")).union(
        readings.filter("row_id % 50 = 0").withColumn("row_id", F.col("row_id") + 100_000).withColumn("part", F.lit(3))
    )
    micros = mixed.withColumn("t_us", F.unix_micros("ts"))
    rolled = rolling.rolling_variance(micros, ["series", "sensor"], "t_us", 60)
    from plantframe.functions.ordered import cooldown

    want = cooldown(rolling.candidates(rolled, base, ["series", "sensor"]), ["series", "sensor", "alert_type"], "t_us", "row_id", 5)
    got = feed(spark, mixed, lambda s: jobs.detector(s.withColumn("t_us", F.unix_micros("ts")), base, "1 hour"), tmp_path, range(4))
    assert got.count() == 0  # nothing has passed the watermark yet
    tail = readings.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(20_000))).withColumn("part", F.lit(9))
    got = feed(spark, tail, lambda s: jobs.detector(s.withColumn("t_us", F.unix_micros("ts")), base, "1 hour"), tmp_path, [9])
    pick = lambda df: sorted((r.row_id, r.alert_type, r.confidence) for r in df.collect())
    assert pick(got) == pick(want) and got.count() > 0


def test_closed_windows_equal_the_batch_windows(spark, readings, tmp_path):
    got = feed(spark, readings, lambda s: jobs.tumbling_stats(s, "30 seconds", "10 seconds"), tmp_path, range(7))
    want = readings.groupBy(F.window("ts", "30 seconds"), "series", "sensor").agg(F.var_samp("value").alias("var"))
    end = readings.agg(F.max("ts")).first()[0]
    closed = want.filter(F.col("window.end") <= F.lit(end) - F.expr("INTERVAL 10 SECONDS"))
    pick = lambda df: sorted((r.sensor, r.window.start, round(r["var"], 9)) for r in df.collect())
    assert pick(got) == pick(closed)


def test_late_rows_are_dropped_and_counted(spark, readings, tmp_path):
    src = str(tmp_path / "in")
    dropped = 0
    for i, part in enumerate((5, 0)):
        readings.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = jobs.tumbling_stats(stream_readings(spark, src), "30 seconds", "10 seconds")
        q = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"), once=True)
        q.awaitTermination()
        dropped += jobs.dropped_rows(q)
    first = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).agg(F.min(F.unix_timestamp("window.start"))).first()[0]
    assert dropped > 0 and first >= 990


def test_reading_schema_names():
    assert READING_SCHEMA.fieldNames() == ["row_id", "series", "sensor", "ts", "value"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Batches that come again, one whose rows were written but not entered, and an empty ledger."""
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.range(0).selectExpr("id", "id * 2 AS v").schema
    assert read_batches(spark, out, schema).count() == 0
    for part in range(3):
        spark.range(part * 10, part * 10 + 10, 1, 1).selectExpr("id", "id * 2 AS v").write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    def forget(number):
        for name in (str(number), f".{number}.crc"):
            (tmp_path / "mark" / "commits" / name).unlink()

    def run():
        write_batches(stream, out, mark, once=True).awaitTermination()
        return sorted((r.id, r.v) for r in read_batches(spark, out, schema).collect())

    want = [(i, 2 * i) for i in range(30)]
    assert run() == want and read_batches(spark, out, schema).select("batch").distinct().count() == 3
    # the last batch was entered, but the stream did not get to know
    forget(2)
    assert run() == want
    # rows of a batch that was not entered are not seen, and replaced when it comes again
    forget(2)
    shutil.rmtree(tmp_path / "out" / "_ledger" / "batch=2")
    spark.range(5).selectExpr("id + 1000 AS id", "id AS v").write.mode("append").parquet(f"{out}/batch=2")
    assert len(read_batches(spark, out, schema).collect()) == 20
    assert run() == want
