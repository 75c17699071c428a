"""What is normal: statistics of the warm-up part of a history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import first_rows, previous_row
from ..functions.ranks import exact_percentile
from ..session import stage

# Fixed values used for tags that have no baseline.
NO_VARIANCE, NO_STD, NO_RATE = 1e-6, 1e-3, 1.0


def _floored(x: Column, floor: float) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(floor))


def detector_baseline(
    warm: DataFrame, keys: Sequence[str] = ("series", "sensor"), least: int = 30
) -> DataFrame:
    """Mean and sample deviation per sensor; sensors with fewer than ``least`` values get none."""
    return (
        warm.groupBy(*keys)
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("_sd"),
            F.var_samp("value").alias("_var"),
            F.count("value").alias("n_rows"),
        )
        .filter(F.col("n_rows") >= least)
        .select(
            *keys, "mean", _floored(F.col("_sd"), 1e-6).alias("std"),
            _floored(F.col("_var"), 1e-9).alias("variance"), "n_rows",
        )
    )


def warmup_buckets(
    buckets: DataFrame, keys: Sequence[str], bucket: str, fraction: float, least: int
) -> DataFrame:
    """The first ``max(least, fraction * n)`` distinct buckets of each key."""
    distinct = buckets.select(*keys, (F.col(bucket) * 1_000_000).alias("_us"), bucket).distinct()
    how_many = F.greatest(F.lit(least), F.floor(F.lit(fraction) * F.col("n")))
    return first_rows(distinct, keys, "_us", "_us", how_many, 86_400.0 * 30).drop("_us")


def window_baseline(
    warm: DataFrame, keys: Sequence[str] = ("series", "sensor"), least: int = 5
) -> DataFrame:
    """Sample statistics over the rows of the warm-up buckets."""
    return (
        warm.groupBy(*keys)
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("_sd"),
            F.var_samp("value").alias("_var"),
            F.count("value").alias("n_rows"),
        )
        .filter(F.col("n_rows") >= least)
        .select(
            *keys, "mean", _floored(F.col("_sd"), 1e-6).alias("std"),
            _floored(F.col("_var"), 1e-12).alias("variance"), "n_rows",
        )
    )


def warmup_rows(
    readings: DataFrame, series: Sequence[str], fraction: float, slice_s: float, least: int = 10
) -> DataFrame:
    """The first ``max(least, fraction * n)`` rows of each series by time."""
    how_many = F.greatest(F.lit(least), F.floor(F.lit(fraction) * F.col("n")))
    return first_rows(readings, series, "t_us", "row_id", how_many, slice_s)


def tag_baseline(warm: DataFrame, keys: Sequence[str], slice_s: float) -> DataFrame:
    """Population statistics per tag and the 99th percentile of the absolute step between rows."""
    known = warm.filter(F.col("value").isNotNull())
    steps = stage(
        previous_row(known, keys, "t_us", "row_id", ["value"], slice_s).select(
            *keys, "value", F.abs(F.col("value") - F.col("prev_value")).alias("step")
        ),
        "warm-up",
    )
    stats = (
        steps.groupBy(*keys)
        .agg(
            F.avg("value").alias("mean"),
            (F.stddev_pop("value") + 1e-12).alias("std"),
            (F.var_pop("value") + 1e-12).alias("variance"),
            F.count(F.lit(1)).alias("n_samples"),
        )
        .filter(F.col("n_samples") >= 2)
    )
    rate = exact_percentile(steps, keys, "step", 0.99, "max_delta_per_step")
    return stats.join(rate, list(keys), "left").select(
        *keys, "mean", "std", "variance",
        F.coalesce("max_delta_per_step", F.lit(0.0)).alias("max_delta_per_step"), "n_samples",
    )
