"""Joins of instants, buckets and runs with intervals.

Grids of doubling widths stand over each other. An interval lies in the finest grid whose cells are at least as long as
it is, so it touches two cells at most, however long it is; an instant looks into its cell of every grid that intervals
use. There is always an equality to hash on, so both sides may be large, and a crowded cell is split by adaptive skew
handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, floor_to, one_value
from ..functions.ordered import carry_forward

CELL, GRID = "_cell", "_grid"
#: Grids over the finest one.
GRIDS = 60


def grid_cells(windows: DataFrame, start: str, end: str, width_us: int) -> DataFrame:
    """Intervals with the number of their grid and each of the cells they touch there; an empty interval has none."""
    length = F.col(end) - F.col(start)
    # the shortest doubled width above the length, without logarithms that round
    widths = F.array(*[F.lit(width_us << i) for i in range(GRIDS) if width_us << i < 1 << 62])
    grid = F.size(F.filter(widths, lambda w: w <= length))
    gridded = windows.filter(length >= 0).withColumn(GRID, grid).withColumn("_w", F.get(widths, F.col(GRID)))
    touched = [F.col(c) - F.pmod(F.col(c), F.col("_w")) for c in (start, end)]
    return gridded.withColumn(CELL, F.explode(F.array_distinct(F.array(*touched)))).drop("_w")


def points_in_windows(
    points: DataFrame,
    t: str,
    windows: DataFrame,
    start: str,
    end: str,
    cell_s: int,
    on: Sequence[str] = (),
) -> DataFrame:
    """Every pair of an instant and a window that holds it, both ends included.

    One row per pair; columns of both sides. ``cell_s`` is the width of the finest grid, about the length of the
    shortest windows. An instant is copied once for each grid in use, of which there are as many as doublings between
    the shortest and the longest window at most.
    """
    width = cell_s * MICROS
    placed = grid_cells(windows, start, end, width)
    used = sorted(r[0] for r in placed.select(GRID).distinct().collect())  # a number below GRIDS each
    if not used:
        return points.join(windows, F.lit(False))
    own = F.explode(F.array(*[F.struct(F.lit(i).alias(GRID), (F.col(t) - F.pmod(F.col(t), F.lit(width << i))).alias(CELL)) for i in used]))
    return (
        points.withColumn("_at", own).select(*points.columns, F.col(f"_at.{GRID}"), F.col(f"_at.{CELL}"))
        .join(placed, [*on, GRID, CELL])
        .filter(F.col(t).between(F.col(start), F.col(end)))
        .drop(GRID, CELL)
    )


def keep_all_windows(windows: DataFrame, key: Sequence[str], summary: DataFrame, zeros: dict) -> DataFrame:
    """Windows with their summary, and with the given defaults where nothing fell into them."""
    return windows.join(summary, list(key), "left").fillna(zeros)


def best_overlap(
    buckets: DataFrame,
    bucket: str,
    width_s: int,
    windows: DataFrame,
    start: str,
    end: str,
    label: str,
    order: str,
    least: float = 0.3,
    otherwise: str = "Normal",
) -> DataFrame:
    """Label each bucket with the window covering the largest share of it, if above ``least``.

    On equal shares the earlier window in ``order`` wins. ``bucket`` is in epoch seconds, the window
    edges in microseconds.
    """
    width = width_s * MICROS
    # a bucket touches a window if it begins in the window or less than its own width in front of it
    reach = windows.select(start, end, label, order, (F.col(start) - (width - 1)).alias("_from")).filter(F.col(end) >= F.col(start))
    asked = buckets.select(bucket).distinct().withColumn("_us", F.col(bucket).cast("long") * MICROS)
    touched = points_in_windows(asked, "_us", reach, "_from", end, width_s)
    overlap = F.least(F.col("_us") + width, F.col(end)) - F.greatest(F.col("_us"), F.col(start))
    share = overlap / F.lit(float(width))
    best = (
        touched.withColumn("_share", share)
        .filter(F.col("_share") > least)
        .groupBy(bucket)
        .agg(F.min(F.struct((-F.col("_share")).alias("s"), F.col(order), F.col(label))).alias("_best"))
        .select(bucket, F.col("_best")[label].alias("true_label"), (-F.col("_best.s")).alias("share"))
    )
    return buckets.join(best, bucket, "left").select(
        *buckets.columns,
        F.coalesce("true_label", F.lit(otherwise)).alias("true_label"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


# A later class in this list takes precedence where class spans overlap.
SPAN_PRIORITY = ("replay", "ddos", "port-scan", "mitm", "ip-scan")


def label_by_span(
    points: DataFrame, t: str, windows: DataFrame, label: str, start: str, end: str,
    priority: Sequence[str] = SPAN_PRIORITY, otherwise: str = "Normal", name: str = "label",
) -> DataFrame:
    """Label rows by the whole span of each class, first start to last end.

    There is one span per class, so the spans travel as one row and no join key is needed.
    """
    spans = windows.groupBy().agg(
        *[
            agg(F.when(F.col(label) == c, F.col(col))).alias(f"_{side}_{i}")
            for i, c in enumerate(priority)
            for side, agg, col in (("s", F.min, start), ("e", F.max, end))
        ]
    )
    held = F.lit(otherwise)
    for i, c in enumerate(priority):
        span = F.col("_w")[f"_s_{i}"], F.col("_w")[f"_e_{i}"]
        held = F.when(F.col(t).between(*span), F.lit(c)).otherwise(held)
    return points.withColumn("_w", one_value(spans)).select(*points.columns, held.alias(name))


def split_by_first_window(
    points: DataFrame, t: str, windows: DataFrame, start: str, end: str, name: str = "part"
) -> DataFrame:
    """Mark rows before the first window as ``before``, inside it as ``inside``, else null."""
    first = windows.agg(F.min(F.struct(start, end)).alias("w")).select(f"w.{start}", f"w.{end}")
    return points.withColumn("_w", one_value(first)).select(
        *points.columns,
        F.when(F.col(t) < F.col("_w")[start], "before")
        .when(F.col(t) <= F.col("_w")[end], "inside")
        .alias(name),
    )


def windows_in_range(
    windows: DataFrame, start: str, points: DataFrame, t: str
) -> DataFrame:
    """Windows that start within the data's time range."""
    limits = points.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return (
        windows.withColumn("_r", one_value(limits))
        .filter(F.col(start).between(F.col("_r._lo"), F.col("_r._hi")))
        .select(*windows.columns)
    )


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], before: int, after: int
) -> DataFrame:
    """Left runs that a right run overlaps, the left one widened by ``before`` and ``after`` steps.

    Both hold ``start_ord``/``end_ord``. Right runs of one key do not overlap each other, so of those
    starting at or before the widened end only the last one can reach furthest: it is found by a running
    maximum over both sides together, in slices of the ordinal line.
    """
    low = F.greatest(F.lit(0), F.col("start_ord") - before)
    asked = left.select(
        *keys, (F.col("end_ord") + after).alias("_at"), F.lit(1).alias("_kind"), low.alias("_low"),
        F.lit(None).cast("long").alias("_end"), "start_ord", "end_ord",
    )
    given = right.select(
        *keys, F.col("start_ord").alias("_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_low"), F.col("end_ord").alias("_end"), "start_ord", "end_ord",
    )
    both = asked.unionByName(given).withColumn(
        "_tie", F.col("_kind") * F.lit(1 << 40) + F.col("start_ord")
    )
    seen = carry_forward(both, keys, "_at", "_tie", "_end", 1.0, "_reach")
    return seen.filter((F.col("_kind") == 1) & (F.col("_reach") >= F.col("_low"))).select(
        *keys, "start_ord", "end_ord"
    )
