"""Rolling variance, spike and frozen-sensor alerts, promotion, cooldown (batch form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS
from ..functions.ordered import cooldown, sliding_count, sliding_variance
from ..session import stage
from .intervals import points_in_windows

# Fixed values of the detector.
WINDOW_S = 60
Z_SPIKE = 3.5
Z_HIGH = 5.0
COLLAPSE_SHARE = 0.05
COOLDOWN_S = 5
PROMOTE_S = 30
PROMOTE_OTHERS = 2
MIN_VALUES = 3
MIN_STD = 1e-5
MIN_VARIANCE = 1e-8

SPIKE, COLLAPSE, CROSS = "z_score_spike", "variance_collapse", "cross_layer"


def rolling_variance(
    readings: DataFrame, keys: Sequence[str], t: str, window_s: float, slice_s: float | None = None
) -> DataFrame:
    """Population variance and count of the trailing window, a row exactly ``window_s`` old included.

    Null values neither count nor get a row.
    """
    known = readings.filter(F.col("value").isNotNull())
    return sliding_variance(known, keys, t, "value", window_s, slice_s=slice_s)


def candidates(rolled: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that satisfy the spike or the collapse rule, one row per rule that holds.

    Sensors without a baseline, and sensors that stood still in warm-up, raise nothing.
    """
    base = baseline.select(*keys, "mean", "std", "variance").filter(F.col("std") >= MIN_STD)
    z = (F.col("value") - F.col("mean")) / F.col("std")
    limit = F.lit(COLLAPSE_SHARE) * F.col("variance")
    frozen = (F.col("rolling_var") < limit) & (F.col("variance") > MIN_VARIANCE)
    spike = F.when(
        F.abs(z) >= Z_SPIKE,
        F.struct(
            F.lit(SPIKE).alias("alert_type"),
            F.round(z, 3).alias("z_score"),
            F.round("rolling_var", 6).alias("rolling_var"),
            F.when(F.abs(z) > Z_HIGH, "high").otherwise("medium").alias("confidence"),
        ),
    )
    collapse = F.when(
        frozen,
        F.struct(
            F.lit(COLLAPSE).alias("alert_type"),
            F.lit(None).cast("double").alias("z_score"),
            F.round("rolling_var", 9).alias("rolling_var"),
            F.when(F.col("rolling_var") < limit / 10, "high").otherwise("medium").alias("confidence"),
        ),
    )
    return (
        rolled.filter(F.col("n_window") >= MIN_VALUES)
        .join(base, list(keys))
        .withColumn("_hit", F.explode(F.array_compact(F.array(spike, collapse))))
        .select(
            *keys, "t_us", "row_id", "_hit.alert_type", "_hit.z_score", "_hit.rolling_var",
            F.round("variance", 6).alias("baseline_var"), "_hit.confidence",
        )
    )


def promote(alerts: DataFrame, series: str, within_s: float, slice_s: float | None = None) -> DataFrame:
    """Collapse alerts with at least two others of the series nearby become cross-layer alerts."""
    is_collapse = F.col("alert_type") == COLLAPSE
    counted = sliding_count(alerts, [series], "t_us", is_collapse, within_s, within_s, slice_s, "_near")
    promoted = is_collapse & (F.col("_near") - 1 >= PROMOTE_OTHERS)
    return counted.withColumn(
        "alert_type", F.when(promoted, CROSS).otherwise(F.col("alert_type"))
    ).drop("_near")


def detect(
    readings: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str] = ("series", "sensor"),
    window_s: float = WINDOW_S,
    cooldown_s: float = COOLDOWN_S,
    promote_s: float = PROMOTE_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Readings to alerts: rolling window, both rules, cooldown per sensor and type, promotion."""
    rolled = rolling_variance(readings, keys, "t_us", window_s, slice_s)
    found = candidates(rolled, baseline, keys)
    kept = cooldown(stage(found, "candidates"), [*keys, "alert_type"], "t_us", "row_id", cooldown_s)
    return promote(kept, keys[0], promote_s, slice_s)


def seconds(us: Column) -> Column:
    return us / F.lit(float(MICROS))


def score_windows(
    windows: DataFrame, key: Sequence[str], alerts: DataFrame, cell_s: int,
    start: str = "start_us", end: str = "end_us", digits: int = 2,
) -> DataFrame:
    """Per attack window: detected, alert count, latency of the first alert, alert types in order."""
    hits = points_in_windows(alerts.select("t_us", "alert_type"), "t_us", windows, start, end, cell_s)
    per = hits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.min("t_us").alias("_first"),
        F.array_join(F.sort_array(F.collect_set("alert_type")), ", ").alias("alert_types"),
    )
    return (
        windows.join(per, list(key), "left")
        .withColumn("latency_s", F.round(seconds(F.col("_first") - F.col(start)), digits))
        .withColumn("duration_s", F.round(seconds(F.col(end) - F.col(start)), 1))
        .withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))
        .withColumn("alert_types", F.coalesce("alert_types", F.lit("")))
        .withColumn("detected", F.col("n_alerts") > 0)
        .drop("_first")
    )


def summarise_detection(scores: DataFrame, by: str = "attack") -> DataFrame:
    """Windows, detected, mean latency and recall per attack type."""
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.col("detected").cast("long")).alias("detected"),
        F.round(F.avg("latency_s"), 2).alias("avg_latency_s"),
        F.round(F.avg(F.col("detected").cast("double")), 3).alias("recall"),
    )


def rollup_detection(scores: DataFrame, by: str = "attack", total: str = "ALL") -> DataFrame:
    """The same with a row over all types."""
    return scores.rollup(by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.col("detected").cast("long")).alias("detected"),
        F.round(F.avg("latency_s"), 2).alias("avg_latency_s"),
        F.round(F.avg(F.col("detected").cast("double")), 4).alias("recall"),
        F.grouping(by).alias("_all"),
    ).select(
        F.when(F.col("_all") == 1, total).otherwise(F.col(by)).alias(by),
        "windows", "detected", "avg_latency_s", "recall",
    )
