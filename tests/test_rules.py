"""Rules at their edges, window labels, scores and specifications."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantframe.operators import constraints as con
from plantframe.operators import intervals, rolling, scoring, specs
from plantframe.sources.specs import parse_spec_json

S = 1_000_000
READING = "series string, bucket long, sensor string, t_us long, row_id long, value double"
KEYS = ["series", "bucket"]


def readings(spark, values):
    rows = []
    for tag, vs in values.items():
        rows += [("s", 0, tag, i * S, len(rows) + i, None if v is None else float(v)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, READING)


def limits(spark, rows):
    return spark.createDataFrame([(t, float(lo), float(hi), "u", 3, "Table 1", "") for t, lo, hi in rows], "tag string, min_val double, max_val double, unit string, page_number int, figure_id string, quote string")


def base(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "series string, tag string, mean double, std double, variance double, max_delta_per_step double")


def loops(spark, rows):
    return spark.createDataFrame(
        [(i, sp, pv, cv, lim, inputs, 7, "Figure 1", "") for i, sp, pv, cv, lim, inputs in rows],
        "loop_id string, setpoint_tag string, process_var_tag string, control_var_tag string, has_rate_limiter boolean, cross_layer_inputs array<string>, page_number int, figure_id string, quote string",
    )


def test_bounds_are_inclusive_and_nulls_do_not_count(spark):
    stats = con.window_stats(readings(spark, {"a": [0, 10], "b": [None, 5], "c": [11], "d": [-1]}), KEYS)
    v = con.bounds_rule(stats, limits(spark, [("a", 0, 10), ("b", 0, 10), ("c", 0, 10), ("absent", 0, 1)]), KEYS)
    assert [(r.constraint_id, r.evidence.split(":")[0], r.spec_page) for r in v.collect()] == [("GC1", "c", 3)]


def test_rate_uses_the_fallback_and_skips_rate_zero(spark):
    steps = con.window_steps(readings(spark, {"a": [0, 3.5], "b": [0, 100], "c": [0, 2.9], "one": [5]}), KEYS, 3600)
    limited = con.rate_limited_loops(loops(spark, [("L" + t, "", "", t, True, []) for t in ("a", "b", "c", "one")] + [("off", "", "", "a", False, [])]))
    v = con.rate_rule(steps, base(spark, [("b", 0.0, 1.0, 1.0, 0.0)]), limited, KEYS, ["series"])
    assert [r.constraint_name for r in v.collect()] == ["rate-limiter-La"]


def test_tracking_and_coupling_need_two_values(spark):
    rows = readings(spark, {"sp": [0, 10], "pv": [5, 5], "single": [5], "in": [0, 9]})
    stats = con.window_stats(rows, KEYS)
    b = base(spark, [("sp", 0.0, 1.0, 1.0, 1.0), ("pv", 0.0, 1.0, 1.0, 1.0), ("in", 0.0, 1.0, 1.0, 1.0)])
    ls = loops(spark, [("L1", "sp", "pv", "", False, ["in"]), ("L2", "sp", "single", "", False, ["in"]), ("L3", "pv", "pv", "", False, [])])
    assert [r.constraint_name for r in con.tracking_rule(stats, b, ls, KEYS, ["series"]).collect()] == ["tracking-invariant-L1"]
    assert [r.constraint_name for r in con.coupling_rule(stats, b, ls, KEYS, ["series"]).collect()] == ["cross-layer-in->pv"]


def test_frozen_valve_counts_a_single_value_as_still(spark):
    tags = con.PlantTags()
    rows = readings(spark, {tags.in_valve: [1], tags.out_valve: [0, 1], tags.level: [6], tags.level_min: [1], tags.level_max: [5]})
    b = spark.createDataFrame([("s", tags.in_valve, 0.5, 0.25), ("s", tags.out_valve, 0.5, 0.25)], "series string, tag string, mean double, variance double")
    w = con.plant_windows(rows, b, KEYS, ["series"])
    assert sorted(r.constraint_id for r in con.apply_constraints(w, KEYS, con.plant_constraints()).collect()) == ["C1", "C3"]
    with_flows = w.withColumn("n_flows", F.lit(10)).withColumn("flows_base", F.lit(0.5))
    # one of two measured valves stands still: not all are frozen, but traffic is high and one is
    assert sorted(r.constraint_id for r in con.apply_constraints(with_flows, KEYS, con.static_constraints()).collect()) == ["C1", "C4"]


def test_window_results_and_features(spark):
    windows = spark.createDataFrame([("s", 0), ("s", 60)], "series string, bucket long")
    found = spark.createDataFrame([("s", 60, "C3"), ("s", 60, "C1"), ("s", 60, "C1")], "series string, bucket long, constraint_id string")
    res = con.window_results(windows, found, KEYS, {"C1": 1.0, "C3": 0.9})
    got = {r.bucket: (r.flagged, r.n_viols, r.flag_reason) for r in res.collect()}
    assert got == {0: (False, 0, "clean"), 60: (True, 3, "C1+C3")}
    f = {r.bucket: r for r in con.feature_row(res, KEYS, {"C1": 1.0, "C3": 0.9}).collect()}
    assert (f[60].rule_C1_flag, f[60].rule_C3_conf, f[0].rule_flagged, f[60].rule_n_viols) == (1.0, 0.9, 0.0, 3.0)
    counts = con.violation_counts(found, ["C1", "C2", "C3"]).collect()
    assert {r.constraint_id: r.n_violations for r in counts} == {"C1": 2, "C2": 0, "C3": 1}


def test_custom_rule(spark):
    def rule(pdf):
        return pdf[["series", "bucket"]].head(1).assign(spread=pdf["value"].max() - pdf["value"].min())

    got = con.custom_rule(readings(spark, {"a": [1, 4]}), KEYS, rule, "series string, bucket long, spread double")
    assert got.first()["spread"] == 3.0


def windows(spark, rows):
    return spark.createDataFrame([(i, a, int(s * S), int(e * S)) for i, (a, s, e) in enumerate(rows)], "win_id long, attack string, start_us long, end_us long")


def test_overlap_label(spark):
    buckets = spark.createDataFrame([(0,), (30,), (60,), (90,)], "bucket long")
    w = windows(spark, [("late", 75, 90), ("ddos", 0, 9), ("mitm", 30, 45), ("replay", 45, 60), ("x", 60, 75)])
    got = {r.bucket: r.true_label for r in intervals.best_overlap(buckets, "bucket", 30, w, "start_us", "end_us", "attack", "win_id").collect()}
    # exactly 0.3 is not enough; of equal shares the first window wins; touching ends share nothing
    assert got == {0: "Normal", 30: "mitm", 60: "late", 90: "Normal"}


def test_window_edges_count_as_inside_and_short_windows_own_no_bucket(spark):
    w = windows(spark, [("ddos", 10, 20), ("mitm", 31, 36)])
    alerts = spark.createDataFrame([(t * S, k) for t, k in [(10, "b"), (20, "a"), (21, "a"), (9, "a")]], "t_us long, alert_type string")
    got = {r.attack: r for r in rolling.score_windows(w, ["win_id"], alerts, 15).collect()}
    assert (got["ddos"].n_alerts, got["ddos"].latency_s, got["ddos"].alert_types, got["ddos"].detected) == (2, 0.0, "a, b", True)
    assert (got["mitm"].n_alerts, got["mitm"].latency_s, got["mitm"].alert_types, got["mitm"].detected) == (0, None, "", False)
    starts = spark.createDataFrame([(0,), (30 * S,)], "b_us long")
    owned = intervals.points_in_windows(starts, "b_us", w, "start_us", "end_us", 30)
    assert owned.count() == 0


def labelled(spark, truth, found, n):
    rows = [("s", i * S, i, any(a <= i <= b for a, b in truth), any(a <= i <= b for a, b in found)) for i in range(n)]
    return spark.createDataFrame(rows, "series string, t_us long, row_id long, truth boolean, flagged boolean")


@pytest.mark.parametrize(
    "found,want",
    [
        ([(210, 289), (610, 689)], (1.0, 0.8, 0.8889, 1.0, 1.0, 1.0)),
        ([(160, 259)], (0.6, 0.3, 0.4, 1.0, 0.5, 0.6667)),
        ([(0, 999)], (0.2, 1.0, 0.3333, 1.0, 1.0, 1.0)),
    ],
)
def test_event_scores_of_three_detectors(spark, found, want):
    df = labelled(spark, [(200, 299), (600, 699)], found, 1000)
    r = scoring.event_report(df, ["series"], "t_us", "row_id", 100).first()
    assert (r.std_precision, r.std_recall, r.std_f1, r.etap, r.etar, r.etapr_f1) == want
    same = scoring.event_report(df, ["series"], "t_us", "row_id", 100, buffer_seconds=3600, step_s=60).first()
    assert same.buffer_steps == 60


@pytest.mark.parametrize("truth,found,want", [([], [(2, 3)], (0.0, 1.0, 0.0)), ([(2, 3)], [], (1.0, 0.0, 0.0)), ([], [], (1.0, 1.0, 1.0))])
def test_event_scores_without_events(spark, truth, found, want):
    r = scoring.event_scores(labelled(spark, truth, found, 10), ["series"], "t_us", "row_id", 1, 3).first()
    assert (r.etap, r.etar, r.etapr_f1) == want


def test_spec_comparison(spark):
    tags, ls = specs.process_spec(spark)
    gone = ["P1_B3005", "P1_FCV03D", "P1_B3003", "P1_TIT01", "P2_SCO", "P3_LCV01"]
    wrong = F.when(F.col("tag") == "P1_FIT01", 12.0).when(F.col("tag") == "P2_RTR", 3000.0).otherwise(F.col("max_val"))
    other = tags.filter(~F.col("tag").isin(gone)).withColumn("max_val", wrong)
    r = specs.compare_specs(tags, other, ls, ls.filter(F.col("loop_id").isin("P1-PC", "P2-SC"))).first()
    assert (r.n_common, r.n_expected, r.n_missing, r.n_extra, r.n_bound_errors, r.n_loops_common, r.n_limiters_right) == (13, 19, 6, 0, 2, 2, 2)


def test_review_and_approval(spark):
    tags, ls = specs.water_spec(spark)
    tags = tags.withColumn("confidence", F.lit(0.85))
    none = spark.createDataFrame([], "spec_name string, kind string, item string")
    assert specs.to_review(tags, ls, none).count() == 2
    one = spark.createDataFrame([("water-plant", "tag", "tank_level_value(2)")], none.schema)
    lifted, _, status = specs.approve(tags, ls, one)
    assert status.first().asDict() == {"spec_name": "water-plant", "n_items": 3, "n_reviewed": 1, "confidence": 0.9, "status": "reviewed"}
    assert sorted(r.confidence for r in lifted.collect()) == [0.85, 1.0]
    assert specs.approve(tags, ls, none)[2].first().status == "pending"


def test_extracted_text(spark):
    text = '```json\nSure: {"tag_specs": [ // all\n{"name": "A", "min_val": null, "max_val": 4}, {"name": "", "max_val": 1}], "loop_specs": [{"loop_id": "L"}]}\n```'
    df = spark.createDataFrame([("good", text), ("bad", "nothing here")], "spec string, text string")
    tags, ls, unread = parse_spec_json(df, "text", "spec")
    t = tags.collect()
    assert [(r.tag, r.min_val, r.max_val, r.confidence) for r in t] == [("A", 0.0, 4.0, 0.85)]
    assert [(r.loop_id, r.confidence, r.has_saturation) for r in ls.collect()] == [("L", 0.75, False)]
    assert [r.spec for r in unread.collect()] == ["bad"]


def test_points_in_windows_of_all_lengths(spark):
    """Against plain loops; a window of a year costs two rows as a window of a second does."""
    rng = np.random.default_rng(6)
    second = 1_000_000
    spans = [(i, int(a), int(a) + int(10 ** rng.uniform(0, 13.5))) for i, a in enumerate(rng.integers(-(10**13), 10**13, 80))]
    spans += [(90, 5 * second, 5 * second), (91, 7 * second, 6 * second), (92, 0, 4 * second - 1), (93, None, 5), (94, -(10**15), 10**15)]
    points = [(i, int(v)) for i, v in enumerate([*rng.integers(-(10**13), 10**13, 300), *[s for _, s, _ in spans if s is not None], *[e for _, _, e in spans]])]
    w = spark.createDataFrame(spans, "win long, s long, e long")
    p = spark.createDataFrame(points, "id long, t long").repartition(3)
    got = sorted((r.id, r.win) for r in intervals.points_in_windows(p, "t", w, "s", "e", 1).collect())
    assert got == sorted((i, j) for i, t in points for j, s, e in spans if s is not None and s <= t <= e)
    assert intervals.grid_cells(w, "s", "e", second).groupBy("win").count().agg(F.max("count")).first()[0] <= 2
    assert intervals.points_in_windows(p, "t", w.limit(0), "s", "e", 1).count() == 0


def test_errors_of_a_rule(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 0.0), (3, 5.0)], "bucket long, value double")

    def rule(rows):
        if rows["value"].iloc[0] == 0:
            raise ZeroDivisionError("no value")
        return rows.assign(flagged=rows["value"].max() > 4)[["bucket", "flagged"]].head(1)

    shape = "bucket long, flagged boolean"
    got = {r.bucket: r.flagged for r in con.custom_rule(df, ["bucket"], rule, shape, on_error="null").collect()}
    assert got == {1: False, 2: None, 3: True}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        con.custom_rule(df, ["bucket"], rule, shape).collect()
    with pytest.raises(ValueError):
        con.custom_rule(df, ["bucket"], rule, shape, on_error="skip")
