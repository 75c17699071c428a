"""Rules over windows. One aggregate per window and tag feeds every rule; a rule is a join with the
limits kept as tables, and a filter. Each violation is a row with its source.

Window statistics are keyed by ``keys`` (for instance series and bucket) and ``tag``. Baselines are
keyed by ``base_keys`` (for instance series) and ``tag``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import general
from ..functions.ordered import previous_row
from ..functions.ranks import exact_percentile
from .baseline import NO_RATE, NO_STD, NO_VARIANCE

DEFINITE, PROBABLE = "definite", "probable"
FROZEN = 0.05  # a variance below this share of the warm-up variance counts as frozen

VIOLATION = [
    "constraint_id", "constraint_name", "severity", "confidence", "evidence",
    "spec_page", "spec_figure", "spec_quote",
]


@dataclass(frozen=True)
class Constraint:
    """A rule of one's own: a condition over columns of a window table."""

    constraint_id: str
    name: str
    severity: str
    confidence: float
    condition: Column


def window_stats(readings: DataFrame, keys: Sequence[str], tag: str = "sensor") -> DataFrame:
    """Everything the rules ask of a window and tag, in one aggregation."""
    known = readings.filter(F.col("value").isNotNull())
    order = F.struct("t_us", "row_id")
    return known.groupBy(*keys, F.col(tag).alias("tag")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.avg("value").alias("mean"),
        F.sum("value").alias("total"),
        F.var_samp("value").alias("var"),
        F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"),
    )


def window_steps(
    readings: DataFrame, keys: Sequence[str], slice_s: float, tag: str = "sensor"
) -> DataFrame:
    """Largest absolute step between neighbouring values inside a window, per tag."""
    known = readings.filter(F.col("value").isNotNull()).withColumnRenamed(tag, "tag")
    stepped = previous_row(known, [*keys, "tag"], "t_us", "row_id", ["value"], slice_s)
    return stepped.groupBy(*keys, "tag").agg(
        F.max(F.abs(F.col("value") - F.col("prev_value"))).alias("max_step")
    )


def _g(name: str, digits: int = 3) -> Column:
    return general(F.col(name), digits)


def _violation(
    df: DataFrame, keys: Sequence[str], cid: str, name: Column, severity: str, confidence: float,
    evidence: Column, page: Column, figure: Column, quote: Column,
) -> DataFrame:
    return df.select(
        *keys,
        F.lit(cid).alias("constraint_id"),
        name.alias("constraint_name"),
        F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        evidence.alias("evidence"),
        page.cast("int").alias("spec_page"),
        figure.alias("spec_figure"),
        quote.alias("spec_quote"),
    )


def _source(cid_quote: Column | None = None) -> tuple[Column, Column, Column]:
    quote = F.nullif(F.col("quote"), F.lit(""))
    return (
        F.col("page_number"),
        F.col("figure_id"),
        F.coalesce(quote, cid_quote) if cid_quote is not None else F.col("quote"),
    )


def bounds_rule(
    stats: DataFrame, tags: DataFrame, keys: Sequence[str], cid: str = "GC1", confidence: float = 0.95
) -> DataFrame:
    """Some value of the window lies outside the tag's limits."""
    limits = tags.select("tag", "min_val", "max_val", "unit", "page_number", "figure_id", "quote")
    hit = stats.join(limits, "tag").filter(
        (F.col("lo") < F.col("min_val")) | (F.col("hi") > F.col("max_val"))
    )
    evidence = F.format_string(
        "%s: [%s, %s] %s outside spec [%s, %s] %s",
        "tag", _g("lo"), _g("hi"), "unit", _g("min_val", 6), _g("max_val", 6), "unit",
    )
    return _violation(
        hit, keys, cid, F.lit("saturation-bounds"), DEFINITE, confidence, evidence, *_source()
    )


def rate_rule(
    steps: DataFrame, baseline: DataFrame, limited: DataFrame, keys: Sequence[str],
    base_keys: Sequence[str], cid: str = "GC2", confidence: float = 0.85, factor: float = 3.0,
) -> DataFrame:
    """A rate-limited output jumps further than three times its usual largest step.

    ``limited`` has one row per rule: ``tag``, ``rule_name`` and the source columns.
    """
    rates = baseline.select(*base_keys, "tag", "max_delta_per_step")
    hit = (
        steps.join(limited, "tag")
        .join(rates, [*base_keys, "tag"], "left")
        .withColumn("_rate", F.coalesce("max_delta_per_step", F.lit(NO_RATE)))
        .filter((F.col("_rate") > 0) & (F.col("max_step") > factor * F.col("_rate")))
    )
    evidence = F.format_string(
        "%s step=%s vs limit %s", "tag", _g("max_step", 4), general(factor * F.col("_rate"), 4)
    )
    return _violation(
        hit, keys, cid, F.col("rule_name"), PROBABLE, confidence, evidence,
        *_source(F.concat(F.col("rule_name"), F.lit(" has a rate limiter"))),
    )


def _pairs(
    stats: DataFrame, loops: DataFrame, driver: str, follower: str, keys: Sequence[str]
) -> DataFrame:
    """Window statistics of the two tags of each loop, side by side."""
    driving = stats.select(
        *keys, F.col("tag").alias(driver), F.col("n").alias("d_n"), F.col("lo").alias("d_lo"),
        F.col("hi").alias("d_hi"), F.col("first_value").alias("d_first"), F.col("last_value").alias("d_last"),
    )
    following = stats.select(
        *keys, F.col("tag").alias(follower), F.col("n").alias("f_n"), F.col("var").alias("f_var")
    )
    return (
        driving.join(loops, driver)
        .join(following, [*keys, follower])
        .filter((F.col("d_n") >= 2) & (F.col("f_n") >= 2))
    )


def _with_base(df: DataFrame, baseline: DataFrame, base_keys: Sequence[str], driver: str, follower: str):
    std = baseline.select(*base_keys, F.col("tag").alias(driver), F.col("std").alias("_std"))
    var = baseline.select(*base_keys, F.col("tag").alias(follower), F.col("variance").alias("_var"))
    return (
        df.join(std, [*base_keys, driver], "left")
        .join(var, [*base_keys, follower], "left")
        .withColumn("_std", F.coalesce("_std", F.lit(NO_STD)))
        .withColumn("_var", F.coalesce("_var", F.lit(NO_VARIANCE)))
    )


def tracking_rule(
    stats: DataFrame, baseline: DataFrame, loops: DataFrame, keys: Sequence[str],
    base_keys: Sequence[str], cid: str = "GC3", confidence: float = 0.90,
    moves: Column | None = None, eps: float = 1e-12,
) -> DataFrame:
    """The set point moves and the process value stands still.

    ``moves`` is a condition over ``sp_range`` and ``sp_std``; by default two warm-up deviations.
    """
    pairs = _pairs(
        stats, loops.filter("setpoint_tag <> process_var_tag"), "setpoint_tag", "process_var_tag", keys
    )
    based = (
        _with_base(pairs, baseline, base_keys, "setpoint_tag", "process_var_tag")
        .withColumn("sp_range", F.col("d_hi") - F.col("d_lo"))
        .withColumnRenamed("_std", "sp_std")
    )
    moved = moves if moves is not None else F.col("sp_range") >= 2.0 * F.col("sp_std")
    hit = based.filter(moved & (F.col("f_var") < FROZEN * (F.col("_var") + eps)))
    evidence = F.format_string(
        "%s range=%s but %s var=%s (warm-up %s)",
        "setpoint_tag", _g("sp_range"), "process_var_tag", _g("f_var"), _g("_var"),
    )
    return _violation(
        hit, keys, cid, F.concat(F.lit("tracking-invariant-"), "loop_id"), DEFINITE, confidence, evidence,
        *_source(F.format_string("loop %s: %s follows %s", "loop_id", "process_var_tag", "setpoint_tag")),
    )


def coupling_rule(
    stats: DataFrame, baseline: DataFrame, loops: DataFrame, keys: Sequence[str],
    base_keys: Sequence[str], cid: str = "GC4", confidence: float = 0.80, eps: float = 1e-12,
) -> DataFrame:
    """An input from another layer changes and the process value stands still."""
    inputs = loops.withColumn("input_tag", F.explode("cross_layer_inputs"))
    pairs = _pairs(stats, inputs, "input_tag", "process_var_tag", keys)
    based = _with_base(pairs, baseline, base_keys, "input_tag", "process_var_tag").withColumn(
        "_delta", F.abs(F.col("d_last") - F.col("d_first"))
    )
    hit = based.filter(
        (F.col("_delta") > 3.0 * F.col("_std") + 1e-9)
        & (F.col("f_var") < FROZEN * (F.col("_var") + eps))
    )
    evidence = F.format_string(
        "%s change=%s but %s var=%s", "input_tag", _g("_delta"), "process_var_tag", _g("f_var")
    )
    return _violation(
        hit, keys, cid, F.format_string("cross-layer-%s->%s", "input_tag", "process_var_tag"), DEFINITE,
        confidence, evidence,
        *_source(F.format_string("loop %s: %s drives %s", "loop_id", "input_tag", "process_var_tag")),
    )


def rate_limited_loops(loops: DataFrame) -> DataFrame:
    """The control outputs of loops with a rate limiter, in the form ``rate_rule`` reads."""
    return loops.filter("has_rate_limiter AND control_var_tag <> ''").select(
        F.col("control_var_tag").alias("tag"),
        F.concat(F.lit("rate-limiter-"), "loop_id").alias("rule_name"),
        "page_number", "figure_id", "quote",
    )


# ---- rules of the water plant ---------------------------------------------------------------

# Fixed values of the plant.
FLOW_DEADBAND = 0.00005
TRAFFIC_FACTOR = 1.8
STILL_IN_WARMUP = 1e-10


@dataclass(frozen=True)
class PlantTags:
    """Register names of the plant."""

    level: str = "tank_level_value(2)"
    level_min: str = "tank_level_min(3)"
    level_max: str = "tank_level_max(4)"
    in_valve: str = "tank_input_valve_status(0)"
    out_valve: str = "tank_output_valve_status(5)"
    flow: str = "tank_output_flow_value(7)"
    traffic: str = "net_flow_count"


def plant_windows(
    readings: DataFrame, baseline: DataFrame, keys: Sequence[str], base_keys: Sequence[str],
    tags: PlantTags = PlantTags(),
) -> DataFrame:
    """One row per window with what the plant rules need.

    ``limit_lo``/``limit_hi`` are the medians of the set-point registers within the window.
    """
    registers = readings.filter(F.col("sensor").isin(tags.level_min, tags.level_max))
    medians = exact_percentile(registers, [*keys, "sensor"], "value", 0.5, "median")
    limits = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("sensor") == tags.level_min, F.col("median"))).alias("limit_lo"),
        F.max(F.when(F.col("sensor") == tags.level_max, F.col("median"))).alias("limit_hi"),
    )

    def value(name: str) -> Column:
        return F.when(F.col("sensor") == name, F.col("value"))

    def share(name: str, condition: Column) -> Column:
        # over all rows of the register; a missing value does not meet the condition
        met = F.coalesce(condition, F.lit(False)).cast("double")
        return F.avg(F.when(F.col("sensor") == name, met))

    level = value(tags.level)
    base = baseline.groupBy(*base_keys).agg(
        F.max(F.when(F.col("tag") == tags.in_valve, F.col("variance"))).alias("in_base"),
        F.max(F.when(F.col("tag") == tags.out_valve, F.col("variance"))).alias("out_base"),
        F.max(F.when(F.col("tag") == tags.traffic, F.col("mean"))).alias("traffic_base"),
    )
    # only the level's rows meet the limits; everything else is aggregated where it is
    outside = (F.col("value") < F.col("limit_lo")) | (F.col("value") > F.col("limit_hi"))
    levels = (
        readings.filter(F.col("sensor") == tags.level)
        .join(limits, list(keys))
        .groupBy(*keys)
        .agg(F.avg(F.coalesce(outside, F.lit(False)).cast("double")).alias("share_outside"))
    )
    rows = readings.groupBy(*keys).agg(
        F.min(level).alias("level_lo"),
        F.max(level).alias("level_hi"),
        F.avg(value(tags.out_valve)).alias("out_mean"),
        share(tags.out_valve, F.col("value") > 0.5).alias("out_open"),
        F.avg(value(tags.flow)).alias("flow_mean"),
        share(tags.flow, F.abs(F.col("value")) < FLOW_DEADBAND).alias("flow_still"),
        F.coalesce(F.var_samp(value(tags.in_valve)), F.lit(0.0)).alias("in_var"),
        F.coalesce(F.var_samp(value(tags.out_valve)), F.lit(0.0)).alias("out_var"),
        F.sum(value(tags.traffic)).alias("traffic"),
    )
    return (
        rows.join(limits, list(keys), "left")
        .join(levels, list(keys), "left")
        .join(base, list(base_keys), "left")
    )


def plant_constraints() -> list[Constraint]:
    """Set-point window, open valve without flow, frozen valve, traffic with a frozen valve."""
    frozen = F.col("in_var") < FROZEN * F.coalesce("in_base", F.lit(NO_VARIANCE))
    return [
        Constraint(
            "C1", "saturation-bounds", DEFINITE, 1.0,
            (F.col("level_hi") > F.col("limit_hi")) | (F.col("level_lo") < F.col("limit_lo")),
        ),
        Constraint(
            "C2", "state-flow-consistency", PROBABLE, 1.0,
            (F.col("out_mean") > 0.8) & (F.col("flow_mean") < FLOW_DEADBAND),
        ),
        Constraint("C3", "valve-cycle-invariant", PROBABLE, 0.9, frozen),
        Constraint(
            "C4", "cross-layer-network-valve-discrepancy", DEFINITE, 0.9,
            (F.col("traffic") > TRAFFIC_FACTOR * F.col("traffic_base")) & frozen,
        ),
    ]


def static_constraints(flow_count: str = "n_flows", flow_base: str = "flows_base") -> list[Constraint]:
    """The share-based variant of the plant rules, with a flow count per window."""

    def measured(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_base") > STILL_IN_WARMUP, F.lit(False))

    def frozen(side: str) -> Column:
        still = F.col(f"{side}_var") < FROZEN * F.col(f"{side}_base")
        return measured(side) & F.coalesce(still, F.lit(False))

    any_frozen = frozen("in") | frozen("out")
    all_frozen = (
        any_frozen
        & (~measured("in") | frozen("in"))
        & (~measured("out") | frozen("out"))
    )
    return [
        Constraint(
            "C1", "saturation-bounds", DEFINITE, 1.0,
            (F.col("limit_hi") > F.col("limit_lo")) & (F.col("share_outside") > 0.10),
        ),
        Constraint(
            "C2", "state-flow-consistency", DEFINITE, 1.0,
            (F.col("out_open") > 0.6) & (F.col("flow_still") > 0.6),
        ),
        Constraint("C3", "valve-cycle-invariant", DEFINITE, 1.0, all_frozen),
        Constraint(
            "C4", "cross-layer-discrepancy", DEFINITE, 1.0,
            (F.col(flow_count) > TRAFFIC_FACTOR * F.greatest(F.col(flow_base), F.lit(1.0))) & any_frozen,
        ),
    ]


def apply_constraints(
    windows: DataFrame, keys: Sequence[str], rules: Sequence[Constraint]
) -> DataFrame:
    """Violations of column rules: one pass over the window table, no join."""
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    r.condition,
                    F.struct(
                        F.lit(r.constraint_id).alias("constraint_id"),
                        F.lit(r.name).alias("constraint_name"),
                        F.lit(r.severity).alias("severity"),
                        F.lit(r.confidence).alias("confidence"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return windows.select(*keys, F.explode(fired).alias("v")).select(*keys, "v.*")


# ---- results per window ----------------------------------------------------------------------


def flag_reason(ids: Column) -> Column:
    """Sorted distinct ids joined with ``+``, or ``clean``."""
    return F.when(F.size(ids) > 0, F.array_join(F.sort_array(ids), "+")).otherwise(F.lit("clean"))


def window_results(
    windows: DataFrame, violations: DataFrame, keys: Sequence[str], confidences: dict[str, float]
) -> DataFrame:
    """One row per window: flag, violation count, reason, violated rules, rule confidences."""
    per = violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_viols"), F.collect_set("constraint_id").alias("ids")
    )
    trust = F.create_map(*[F.lit(x) for pair in confidences.items() for x in pair])
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return windows.join(per, list(keys), "left").select(
        *windows.columns,
        (F.coalesce("n_viols", F.lit(0)) > 0).alias("flagged"),
        F.coalesce("n_viols", F.lit(0)).alias("n_viols"),
        flag_reason(ids).alias("flag_reason"),
        F.sort_array(ids).alias("ids"),
        trust.alias("confidence"),
    )


def feature_row(results: DataFrame, keys: Sequence[str], confidences: dict[str, float], prefix: str = "rule") -> DataFrame:
    """Flat numeric features per window, one flag and one confidence column per rule."""
    return results.select(
        *keys,
        F.col("flagged").cast("double").alias(f"{prefix}_flagged"),
        F.col("n_viols").cast("double").alias(f"{prefix}_n_viols"),
        *[F.lit(c).alias(f"{prefix}_{i}_conf") for i, c in confidences.items()],
        *[
            F.array_contains("ids", i).cast("double").alias(f"{prefix}_{i}_flag")
            for i in confidences
        ],
    )


def violation_counts(violations: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Violations per rule, 0 for rules that never fired."""
    one = violations.groupBy().agg(
        *[F.count(F.when(F.col("constraint_id") == i, F.lit(1))).alias(i) for i in ids]
    )
    return one.unpivot([], list(ids), "constraint_id", "n_violations")


def custom_rule(
    readings: DataFrame, keys: Sequence[str], rule: Callable, schema: str, on_error: str = "raise"
) -> DataFrame:
    """A free-form rule on the rows of one window, for what no column condition can say.

    An error of the rule fails the query; with ``on_error="null"`` its window has one row with its keys, where the
    schema has them, and nulls elsewhere, and other windows are evaluated as ever. A window's rows meet in one task, so
    prefer ``apply_constraints``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is raise or null")
    if on_error == "raise":
        return readings.groupBy(*keys).applyInPandas(rule, schema)
    names = T.StructType.fromDDL(schema).fieldNames()

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return rule(rows)
        except Exception:  # noqa: BLE001 - what the caller asked for
            return pd.DataFrame({c: [rows[c].iloc[0] if c in keys else None] for c in names})

    return readings.groupBy(*keys).applyInPandas(guarded, schema)
