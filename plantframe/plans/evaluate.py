"""Whole evaluations: readings in, violations, window results and scores out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, few, join_keys, time_bucket
from ..functions.ordered import first_rows
from ..operators import baseline as base
from ..operators import constraints as con
from ..operators import rolling, scoring
from ..operators.intervals import split_by_first_window, windows_in_range
from ..operators.specs import RATE_LIMITED
from ..session import stage

GENERIC = {"GC1": 0.95, "GC2": 0.85, "GC3": 0.90, "GC4": 0.80}
PROCESS = {"C1": 1.0, "C2": 0.85, "C3": 0.95, "C4": 0.80}
WATER = {"C1": 1.0, "C2": 1.0, "C3": 0.9, "C4": 0.9}

# Fixed values of the process plant's speed loop.
SPEED_DEMAND, SPEED, POWER_DEMAND, SPEED_RAMP = "P2_AutoSD", "P2_SIT01", "P4_ST_PS", 50.0


#: Part of a data set's name, the rules that go with it, and a tag they can't do without.
RULE_SETS: dict[str, tuple[str, str | None]] = {"process": ("process", None), "water": ("water", con.PlantTags().traffic)}


def choose_rules(spec_name: str, tags: Sequence[str], sets: Mapping[str, tuple[str, str | None]] = RULE_SETS) -> tuple[str, str]:
    """Which rules a data set gets and why: its own by its name, the generic ones if it has none or misses a tag."""
    for part, (rules, needed) in sets.items():
        if part in spec_name.lower():
            return ("generic", f"{needed} is missing") if needed is not None and needed not in tags else (rules, f"named {part}")
    return "generic", "no rules of its own"


def generic_violations(
    readings: DataFrame, stats: DataFrame, baseline: DataFrame, tags: DataFrame, loops: DataFrame,
    keys: Sequence[str], base_keys: Sequence[str], slice_s: float,
) -> DataFrame:
    """All four generic rules over one window aggregate."""
    limited = con.rate_limited_loops(loops)
    asked = readings.join(limited.select(F.col("tag").alias("sensor")).distinct(), "sensor", "left_semi")
    steps = con.window_steps(asked, keys, slice_s)
    return (
        con.bounds_rule(stats, tags, keys)
        .unionByName(con.rate_rule(steps, baseline, limited, keys, base_keys))
        .unionByName(con.tracking_rule(stats, baseline, loops, keys, base_keys))
        .unionByName(con.coupling_rule(stats, baseline, loops, keys, base_keys))
    )


def process_rate_tags(spark) -> DataFrame:
    """The fixed list of rate-limited tags, in the form the rate rule reads."""
    rows = [(t, "rate-limiter-invariant", 9, "Figures 4-13", "") for t in RATE_LIMITED]
    return spark.createDataFrame(rows, "tag STRING, rule_name STRING, page_number INT, figure_id STRING, quote STRING")


def speed_loop(spark) -> DataFrame:
    row = ("P2-SC", SPEED_DEMAND, SPEED, [POWER_DEMAND], 10, "Figure 11", "speed follows its set point")
    return spark.createDataFrame(
        [row],
        "loop_id STRING, setpoint_tag STRING, process_var_tag STRING, cross_layer_inputs ARRAY<STRING>, "
        "page_number INT, figure_id STRING, quote STRING",
    )


def process_violations(
    readings: DataFrame, stats: DataFrame, baseline: DataFrame, tags: DataFrame, keys: Sequence[str],
    base_keys: Sequence[str], slice_s: float, spec_confidence: float = 1.0,
) -> DataFrame:
    """The process plant's rules: limits, rate-limited outputs, turbine speed tracking and coupling.

    With extracted limits pass their tag table and ``spec_confidence=0.85``.
    """
    spark = readings.sparkSession
    steps = con.window_steps(readings.filter(F.col("sensor").isin(RATE_LIMITED)), keys, slice_s)
    loop = speed_loop(spark)
    ramp = F.col("sp_range") > SPEED_RAMP
    return (
        con.bounds_rule(stats, tags, keys, "C1", spec_confidence)
        .unionByName(con.rate_rule(steps, baseline, process_rate_tags(spark), keys, base_keys, "C2"))
        .unionByName(con.tracking_rule(stats, baseline, loop, keys, base_keys, "C3", 0.95, ramp, 1e-9))
        .unionByName(con.coupling_rule(stats, baseline, loop, keys, base_keys, "C4", 0.80, 1e-9))
    )


def window_truth(labelled: DataFrame, keys: Sequence[str], attack: str = "attack") -> DataFrame:
    """A window is an attack if any of its rows is."""
    return labelled.groupBy(*keys).agg((F.max(F.col(attack).cast("int")) == 1).alias("truth"))


@dataclass
class Evaluation:
    violations: DataFrame
    windows: DataFrame
    report: DataFrame
    per_rule: DataFrame
    rules: str
    reason: str


def split_warmup(readings: DataFrame, share: float, slice_s: float) -> tuple[DataFrame, DataFrame]:
    """The readings up to the last of each series' first instants, and those after it.

    Instants are counted, not readings: a snapshot of many sensors is one.
    """
    instants = readings.select("series", "t_us").distinct()
    warm = first_rows(instants, ["series"], "t_us", "t_us", F.floor(F.lit(share) * F.col("n")), slice_s)
    cut = few(warm.groupBy("series").agg(F.max("t_us").alias("_cut")), "cut")
    marked = join_keys(readings, cut, ["series"], "left").withColumn("_warm", F.coalesce(F.col("t_us") <= F.col("_cut"), F.lit(False)))
    return tuple(marked.filter(side).drop("_cut", "_warm") for side in ("_warm", "NOT _warm"))


def evaluate(
    readings: DataFrame, tags: DataFrame, loops: DataFrame, spec_name: str, window_s: int = 60,
    warmup: float = 0.15, buffer_steps: int = 60, slice_s: float = 3600.0, rules: str | None = None,
    train: DataFrame | None = None, sets: Mapping[str, tuple[str, str | None]] = RULE_SETS,
) -> Evaluation:
    """Readings ``(series, sensor, t_us, row_id, value, attack)`` to scores.

    The baseline comes from the first instants of each series, a share of ``warmup`` of them, and the rest is scored;
    with a table of its own to learn from (``train``), all of ``readings`` is scored. The window aggregate is written
    once; rules, results and scores read that table. The result names the rules in use and why (``choose_rules``).
    """
    if train is None:
        train, readings = split_warmup(readings, warmup, slice_s)
    mine, own_loops = tags.filter(F.col("spec_name") == spec_name), loops.filter(F.col("spec_name") == spec_name)
    bucketed = readings.withColumn("bucket", time_bucket(F.col("t_us"), window_s))
    keys, base_keys = ["series", "bucket"], ["series"]
    sensors = [row[0] for row in readings.select("sensor").distinct().collect()] if rules is None else []
    chosen, reason = (rules, "asked for") if rules else choose_rules(spec_name, sensors, sets)
    baseline = stage(
        base.tag_baseline(train.withColumnRenamed("sensor", "tag"), ["series", "tag"], slice_s), "baseline"
    )
    stats = stage(con.window_stats(bucketed, keys), "windows")
    if chosen == "process":
        confidences = PROCESS
        found = process_violations(bucketed, stats, baseline, mine, keys, base_keys, slice_s)
    elif chosen == "water":
        confidences = WATER
        per = con.plant_windows(bucketed, baseline, keys, base_keys)
        found = con.apply_constraints(per, keys, con.plant_constraints())
    else:
        confidences = GENERIC
        found = generic_violations(bucketed, stats, baseline, mine, own_loops, keys, base_keys, slice_s)
    found = stage(found, "violations")
    windows = con.window_results(stats.select(*keys).distinct(), found, keys, confidences)
    truth = window_truth(bucketed, keys)
    labelled = stage(
        windows.join(truth, keys).withColumn("t_us", F.col("bucket") * MICROS).drop("confidence"), "results"
    )
    line = window_s * 100_000.0
    report = scoring.event_report(labelled, ["series"], "t_us", "bucket", line, buffer_steps)
    return Evaluation(found, windows, report, rule_report(labelled, list(confidences), line, buffer_steps), chosen, reason)


def rule_report(
    windows: DataFrame, ids: Sequence[str], slice_s: float, buffer_steps: int = 60
) -> DataFrame:
    """Each rule scored as a detector of its own, all rules in one pass with the rule as a key."""
    one = windows.select(
        "series", "t_us", "bucket", "truth",
        F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.array_contains("ids", i).alias("hit")) for i in ids])).alias("r"),
    ).select("series", "t_us", "bucket", "truth", F.col("r.rule").alias("rule"), F.col("r.hit").alias("flagged"))
    return scoring.event_report(one, ["series", "rule"], "t_us", "bucket", slice_s, buffer_steps)


def detect_and_score(
    readings: DataFrame, windows: DataFrame, window_s: float = 60, cooldown_s: float = 5,
    promote_s: float = 30, cell_s: int = 600, slice_s: float | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detector on a history with an attack timeline: alerts, score per attack window, summary.

    Warm-up ends where the first attack window starts; all series share one absolute clock.
    """
    inside = windows_in_range(windows, "start_us", readings, "t_us")
    parted = split_by_first_window(readings, "t_us", inside, "start_us", "end_us")
    baseline = base.detector_baseline(parted.filter("part = 'before'"))
    alerts = stage(
        rolling.detect(readings, baseline, ("series", "sensor"), window_s, cooldown_s, promote_s, slice_s), "alerts"
    )
    scores = rolling.score_windows(inside, ["win_id"], alerts, cell_s)
    return alerts, scores, rolling.rollup_detection(scores)
