"""Order statistics that stay exact and spread out when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .columns import few, join_keys, sized

#: Bins that the range of a wanted rank is cut into in each round.
BINS = 4096


def _bin(x: Column, low: Column, high: Column, by_size: bool) -> Column:
    """Number of the bin of a value between low and high, in the order of the values.

    Bins are equal parts of the range, or, ``by_size``, of the range of logarithms if that is wide, and of the signs if
    the range holds zero. Infinite ends have bins of their own, and NaN, which sorts last.
    """
    ends = F.when(F.isnan(x), 3).when(x == float("inf"), 2).when(x == float("-inf"), 0).otherwise(1)
    width = high / 2 - low / 2
    equal = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((x / 2 - low / 2) / width * BINS))).otherwise((x > low).cast("long"))
    whole = F.isnan(low) | F.isnan(high) | (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    if by_size:
        small, large = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
        span = F.log(large) - F.log(small)
        steps = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.log(F.abs(x)) - F.log(small)) / span * BINS)))
        by_log = F.when(low > 0, steps).otherwise(-steps)
        wide = (low > 0) & (high > low * 16) | (high < 0) & (low < high * 16)
        equal = F.when((low <= 0) & (high >= 0), F.signum(x).cast("long")).when(wide, by_log).otherwise(equal)
    return F.when(whole, ends).otherwise(equal).cast("long")


def _percentile(data: DataFrame, keys: Sequence[str], q: float, name: str) -> DataFrame:
    """Percentile per group of values ``_x`` that stand for ``_w`` rows each, by radix selection.

    Each round counts the bins of the range that holds the wanted rank and goes on with one bin, between the smallest
    and the largest value in it, until these are equal. Counting combines in every task; no task sees more of a group
    than its bins, and rows are never ordered.
    """
    data = stage(data, "values")
    position = F.lit(q) * (F.col("n") - 1)
    ranked = data.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.sum("_w").alias("n"))
    state = stage(ranked.select(*keys, "lo", "hi", F.floor(position).alias("rank"), (position - F.floor(position)).alias("part"), F.lit(0).cast("long").alias("before")), "ranks")
    turn = 0
    while not state.filter("lo < hi").isEmpty():
        parts = F.struct("lo", "hi", "rank", "part", "before").alias("_s")
        open_ = sized(state.filter("lo < hi").select(*keys, parts))
        inside = join_keys(data, open_, keys).filter(F.col("_x").between(F.col("_s.lo"), F.col("_s.hi")))
        number = _bin(F.col("_x"), F.col("_s.lo"), F.col("_s.hi"), turn % 2 == 1)
        counted = inside.groupBy(*keys, number.alias("_b")).agg(F.sum("_w").alias("_c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.first("_s").alias("_s"))
        line = Window.partitionBy(*keys).orderBy("_b")
        upto = counted.withColumn("_upto", F.col("_s.before") + F.sum("_c").over(line))
        holding = upto.filter((F.col("_upto") > F.col("_s.rank")) & (F.col("_upto") - F.col("_c") <= F.col("_s.rank")))
        narrowed = holding.select(*keys, "lo", "hi", "_s.rank", "_s.part", (F.col("_upto") - F.col("_c")).alias("before"))
        state = stage(narrowed.unionByName(state.filter("NOT lo < hi")), "ranks")
        turn += 1
    # the value at the rank is found; the next one is the same if it repeats, else the smallest above it
    found = sized(state.select(*keys, F.struct("lo", "rank", "part", "before").alias("_s")))
    after = join_keys(data, found, keys).filter(F.col("_x") >= F.col("_s.lo"))
    ends = after.groupBy(*keys).agg(
        F.first("_s").alias("_s"), F.sum(F.when(F.col("_x") == F.col("_s.lo"), F.col("_w"))).alias("_c"), F.min(F.when(F.col("_x") > F.col("_s.lo"), F.col("_x"))).alias("_z"),
    )
    same = (F.col("_s.part") == 0) | (F.col("_s.before") + F.col("_c") > F.col("_s.rank") + 1)
    low, part = F.col("_s.lo"), F.col("_s.part")
    return ends.select(*keys, F.when(same, low).otherwise(low * (1 - part) + F.col("_z") * part).alias(name))


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str
) -> DataFrame:
    """Linear-interpolated percentile per group, as ``percentile`` gives it; null values don't count.

    ``percentile`` keeps every distinct value of a group in one task; this counts bins in rounds instead.
    """
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), F.lit(1).cast("long").alias("_w"))
    return _percentile(data, keys, q, name)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per group. Spark cuts each task to n per group before the shuffle."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(line)).filter(F.col("_rn") <= n).drop("_rn")


def split_by_rank(
    df: DataFrame, keys: Sequence[str], order_hex: Column, fraction: float, name: str = "held_out"
) -> DataFrame:
    """Mark exactly ``floor(fraction * n)`` rows per group, the first by a hex order without ties.

    Groups are cut into 65,536 bins by the hash's head; the counts tell which bin holds the last row
    wanted, and only that bin is ordered. Marking is then a comparison with one hash per group.
    """
    hashed = df.select(*keys, order_hex.alias("_h")).withColumn("_bin", F.substring("_h", 1, 4))
    line = Window.partitionBy(*keys)
    holding = (
        hashed.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_k", F.floor(F.lit(fraction) * F.sum("_c").over(line)))
        .withColumn("_upto", F.sum("_c").over(line.orderBy("_bin")))
        .select(*keys, "_bin", (F.col("_upto") - F.col("_c")).alias("_before"), "_upto", "_k")
        .filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_upto")))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_h")
    cut = (
        join_keys(hashed, few(holding, "holding"), [*keys, "_bin"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_before") + F.col("_rn") == F.col("_k"))
        .select(*keys, F.col("_h").alias("_cut"))
    )
    marked = F.coalesce(order_hex <= F.col("_cut"), F.lit(False))
    return join_keys(df, few(cut, "cut"), keys, "left").select(*[F.col(c) for c in df.columns], marked.alias(name))


def running_total(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], prefix: str = "before_") -> DataFrame:
    """Add, per measure, its sum over the rows of the key with a smaller value.

    ``df`` holds one row per key and value. Spark deals the rows out by ranges of key and value, and they are written
    as dealt; ranges are summed first, then each one is ordered on its own. A key of any size spreads over ranges.
    """
    ranged = stage(df.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(m) for m in measures])
    line = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", *[F.coalesce(F.sum(m).over(line), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return join_keys(ranged, offsets, [*keys, "_part"]).select(
        *df.columns, *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(prefix + m) for m in measures]
    )


def weighted_percentile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, name: str
) -> DataFrame:
    """Linear-interpolated percentile of values that stand for ``weight`` rows each; null values don't count."""
    known = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    return _percentile(known.select(*keys, F.col(value).cast("double").alias("_x"), F.col(weight).cast("long").alias("_w")), keys, q, name)
