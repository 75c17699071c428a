import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plantframe.operators import align
from plantframe.operators.specs import process_spec
from plantframe.plans import evaluate as ev
from plantframe.session import shared_folder, stage
from plantframe.sources import readers, sinks
from plantframe.sources.specs import load_specs

S = 1_000_000


def test_snapshots(spark, tmp_path):
    (tmp_path / "p.csv").write_text(" time, tank_level_value(2) ,other\n2022-09-16 12:00:01.5,3.5,1\nbroken,1,1\n2022-09-16 12:00:00,nan,1\n")
    got = readers.read_snapshots(spark, str(tmp_path / "p.csv"), ["tank_level_value(2)", "absent"], "PLC1").orderBy("ts").collect()
    assert [r.elapsed_s for r in got] == [0.0, 1.5]
    assert [r["tank_level_value(2)"] for r in got] == [None, 3.5]
    assert got[0].unix_ts == 1663329600 and got[0].series == "PLC1"


def test_empty_timeline(spark, tmp_path):
    (tmp_path / "a.csv").write_text("attack,startStamp,endStamp,startTime,endTime,attackerMAC,attackerIP,description\n")
    assert readers.read_attack_windows(spark, str(tmp_path / "a.csv")).count() == 0


def test_flows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("start,protocol,sLoad,unknown_column,IT_M_Label\n1.5,,x,1,Normal\n")
    r = readers.read_flows(spark, str(tmp_path / "f.csv")).first()
    assert r.asDict() == {"start": 1.5, "protocol": None, "sLoad": None, "IT_M_Label": "Normal"}


def test_tagged_files_by_name(spark, tmp_path):
    (tmp_path / "normal1.csv").write_text("Time,P1_A\n2022-01-01 00:00:00,1\n")
    (tmp_path / "normal2.csv").write_text("timestamp, P1_B,label\n2022-01-01 00:00:01,2,1\n")
    (tmp_path / "test1.csv").write_text("time,P1_A\n2022-01-02 00:00:00,9\n")
    got = readers.read_tagged(spark, str(tmp_path), "train", ["P1_A", "P1_B"]).orderBy("ts").collect()
    assert [(r.attack, r.P1_A, r.P1_B, r.file) for r in got] == [(0, 1.0, None, "normal1.csv"), (1, None, 2.0, "normal2.csv")]
    with pytest.raises(FileNotFoundError):
        readers.read_tagged(spark, str(tmp_path / "none"), "train", ["P1_A"])


def test_missing_time_column(spark):
    df = spark.createDataFrame([(7, 1.0)], "n long, x double")
    assert readers.resolve_columns(df, row_number="n").first()["ts"] == dt.datetime(1970, 1, 1, 0, 0, 7)
    with pytest.raises(ValueError):
        readers.resolve_columns(df)


def test_spec_files(spark, tmp_path):
    tag = {"name": "A", "min_val": 0.0, "max_val": 1.0, "source": {"confidence": 0.5}}
    spec = {"dataset_name": "d", "tag_specs": {"A": tag}, "loop_specs": {"L": {"loop_id": "L", "setpoint_tag": "A"}}}
    (tmp_path / "a.json").write_text(json.dumps(spec))
    (tmp_path / "b.json").write_text(json.dumps({"spec": {**spec, "dataset_name": "e"}, "meta": {}}))
    tags, loops = load_specs(spark, str(tmp_path))
    assert sorted((r.spec_name, r.tag, r.confidence, r.unit) for r in tags.collect()) == [("d", "A", 0.5, ""), ("e", "A", 0.5, "")]
    assert sorted((r.spec_name, r.setpoint_tag, r.has_saturation, r.cross_layer_inputs) for r in loops.collect()) == [("d", "A", False, []), ("e", "A", False, [])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "x int, ids array<string>")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first()["ids"] == '["a","b"]'
    sinks.write_report({"rules": df, "empty": df.filter("x > 1")}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).select("rules.x").first()[0] == [1]


def test_stage_goes_to_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(3), "x")
    assert staged.count() == 3 and "plantframe-x-" in staged.inputFiles()[0]


@pytest.mark.parametrize("shuffled", [False, True])
def test_whole_evaluation(spark, shuffled):
    """Ten minutes at one row a second: limits broken in minute 5, speed frozen on a ramp in minute 8."""
    rows = []
    for i in range(600):
        ramp = 480 <= i < 540
        demand = 1000 + (i % 60) * 5.0
        speed = 1000.0 if ramp else demand + (i % 7)
        level = 900.0 if 300 <= i < 310 else 300.0 + i % 11
        for tag, v in (("P2_AutoSD", demand), ("P2_SIT01", speed), ("P1_LIT01", level)):
            # what is marked as an attack in warm-up is not scored
            rows.append(("plant", tag, i * S, len(rows), v, int(300 <= i < 360 or ramp or 60 <= i < 120)))
    df = spark.createDataFrame(rows, "series string, sensor string, t_us long, row_id long, value double, attack int")
    if shuffled:
        df = df.repartition(7, "value")
    tags, loops = process_spec(spark)
    e = ev.evaluate(df, tags, loops, "process-plant", warmup=0.25, buffer_steps=1, slice_s=30)
    assert sorted((r.bucket, r.constraint_id) for r in e.violations.collect()) == [(300, "C1"), (480, "C3")]
    assert {r.bucket: r.flag_reason for r in e.windows.filter("flagged").collect()} == {300: "C1", 480: "C3"}
    r = e.report.first()
    assert (r.n_true_events, r.n_pred_clusters, r.std_f1, r.etapr_f1) == (2, 2, 1.0, 1.0)
    assert {r.rule: r.std_recall for r in e.per_rule.collect()} == {"C1": 0.5, "C2": 0.0, "C3": 0.5, "C4": 0.0}
    assert min(r.bucket for r in e.windows.collect()) == 120
    learned = ev.evaluate(df.filter(f"t_us >= {150 * S}"), tags, loops, "process-plant", buffer_steps=1, slice_s=30, train=df.filter(f"t_us < {150 * S}"))
    assert sorted((r.bucket, r.constraint_id) for r in learned.violations.collect()) == [(300, "C1"), (480, "C3")]
    generic = ev.evaluate(df, tags, loops, "process-plant", warmup=0.25, buffer_steps=1, slice_s=30, rules="generic")
    assert {r.constraint_id for r in generic.violations.collect()} == {"GC1", "GC3"}


def test_detect_and_score(spark):
    rows = [("s", x, i * S, 3 * i + k, 1.0 if 400 <= i < 500 else float((i * 7 + k * 3) % 10)) for i in range(600) for k, x in enumerate("abc")]
    df = spark.createDataFrame(rows, "series string, sensor string, t_us long, row_id long, value double")
    w = spark.createDataFrame([(0, "replay", 400 * S, 499 * S), (1, "ddos", 550 * S, 560 * S), (2, "mitm", 9000 * S, 9001 * S)], "win_id long, attack string, start_us long, end_us long")
    alerts, scores, summary = ev.detect_and_score(df, w)
    got = {r.attack: (r.windows, r.detected) for r in summary.collect()}
    assert got == {"replay": (1, 1), "ddos": (1, 0), "ALL": (2, 1)}
    assert {r.alert_type for r in alerts.filter("t_us between 460000000 and 499000000").collect()} == {"cross_layer"}
    assert scores.filter("attack = 'replay'").first().alert_types == "cross_layer"


def test_time_text(spark):
    from plantframe.functions.columns import to_instant

    df = spark.createDataFrame([("2022-09-16 12:00:00.25",), ("2022-09-16T14:00:00+02:00",), ("2022-09-16T12:00:00Z",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_micros(to_instant("t"))).collect()]
    assert got == [1663329600250000, 1663329600000000, 1663329600000000, None, None]


def test_comments_with_quotes_and_slashes_in_strings(spark):
    from plantframe.sources.specs import clean_json

    text = 'Here it is:\n```json\n{"a": "x // y \\" z", // it is "said", isn\'t it\n "b": 1 /* "c": 2 */}\n```\n done'
    got = spark.createDataFrame([(text,), ("no object",), (None,), ("} {",)], "t string").select(clean_json(F.col("t"))).collect()
    assert [r[0] for r in got[1:]] == [None, None, None]
    import json

    assert json.loads(got[0][0]) == {"a": 'x // y " z', "b": 1}


def test_files_order_their_columns_differently(spark, tmp_path):
    from plantframe.sources.readers import text_table

    (tmp_path / "a.csv").write_text("start, duration ,sLoad\n1,2,3\n")
    (tmp_path / "b.csv").write_text("duration,sLoad,start\n20,30,10\n")
    (tmp_path / "c.csv").write_text("start,extra\n100,x\n")
    rows = {r.start: (r.duration, r.sLoad, r.extra) for r in text_table(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("2", "3", None), "10": ("20", "30", None), "100": (None, None, "x")}


def test_choice_of_rules():
    own = {"boiler": ("process", "steam"), "pump": ("water", None)}
    assert ev.choose_rules("Pump station", [], own) == ("water", "named pump")
    assert ev.choose_rules("boiler-7", ["x"], own) == ("generic", "steam is missing")
    assert ev.choose_rules("boiler-7", ["steam"], own) == ("process", "named boiler")
    assert ev.choose_rules("mill", ["steam"], own) == ("generic", "no rules of its own")


def test_one_hot_values(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, c string")
    got = align.one_hot(df, "c").orderBy("id")
    assert got.columns == ["id", "c", "c_a", "c_b", "c_unknown"] and [tuple(r)[2:] for r in got.collect()] == [(0, 1, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0)]
    assert [r.c_a for r in align.one_hot(df, "c", ["a"], unseen="zero").orderBy("id").collect()] == [0, 0, 1, 0]
    with pytest.raises(Exception, match="without a column: b"):
        align.one_hot(df.filter("id <> 2"), "c", ["a"]).collect()
    with pytest.raises(ValueError):
        align.one_hot(df, "c", most=2)
