"""Clock alignment, buckets, and joins of layers on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, few, join_keys, one_value
from ..functions.ranks import exact_percentile, weighted_percentile
from ..session import stage


def melt(df: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Wide snapshots to one row per sensor value."""
    wide = df.select(*ids, *[F.col(f"`{s}`").cast("double").alias(s) for s in sensors])
    return wide.unpivot(list(ids), [F.col(f"`{s}`") for s in sensors], "sensor", "value")


def with_elapsed(df: DataFrame, series: Sequence[str], t_us: str, name: str = "elapsed_s") -> DataFrame:
    """Seconds since the first instant of the row's own series, or of the table if there is one series.

    The first instants are one small aggregate; the rows are not moved or ordered.
    """
    first = df.groupBy(*series).agg(F.min(t_us).alias("_t0"))
    if series:
        based = join_keys(df, few(first, "first"), series)
    else:
        based = df.withColumn("_t0", one_value(first)["_t0"])
    return based.select(*df.columns, ((F.col(t_us) - F.col("_t0")) / F.lit(float(MICROS))).alias(name))


def clock_offset(a: DataFrame, a_us: str, b: DataFrame, b_us: str) -> DataFrame:
    """Offset between two recorders, as the difference of their first instants, in seconds."""
    first = a.agg(F.min(a_us).alias("t"), F.lit("a").alias("side")).unionByName(
        b.agg(F.min(b_us).alias("t"), F.lit("b").alias("side"))
    )
    return first.agg(
        (
            (F.max(F.when(F.col("side") == "a", F.col("t")))
             - F.max(F.when(F.col("side") == "b", F.col("t"))))
            / F.lit(float(MICROS))
        ).alias("offset_s")
    )


def bucket_spread(
    readings: DataFrame, keys: Sequence[str], sensor: str = "sensor", value: str = "value"
) -> DataFrame:
    """Sample variance (null for one row) and range per bucket and sensor."""
    return readings.groupBy(*keys, sensor).agg(
        F.var_samp(value).alias("var"), (F.max(value) - F.min(value)).alias("range")
    )


def spread_wide(
    readings: DataFrame, keys: Sequence[str], sensors: Sequence[str], prefix: str
) -> DataFrame:
    """The same, one row per bucket with a variance and a range column per sensor."""
    aggs: list[Column] = []
    for s in sensors:
        x = F.when(F.col("sensor") == s, F.col("value"))
        aggs += [
            F.var_samp(x).alias(f"{prefix}_var_{s}"),
            (F.max(x) - F.min(x)).alias(f"{prefix}_range_{s}"),
        ]
    return readings.groupBy(*keys).agg(*aggs)


def _fill_from(df: DataFrame, one_row: DataFrame, cols: Sequence[str]) -> DataFrame:
    filled = df.withColumn("_fill", one_value(one_row))
    return filled.select(
        *[F.coalesce(F.col(c), F.col("_fill")[c]).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def _one_row(medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    return medians.groupBy().agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in cols]
    )


def fill_with_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the column's median over the rows of this table."""
    long = df.select(*cols).unpivot([], list(cols), "name", "x")
    return _fill_from(df, _one_row(exact_percentile(long, ["name"], "x", 0.5, "median"), cols), cols)


def fuse(flows: DataFrame, buckets: DataFrame, on: Sequence[str], fill: bool = True) -> DataFrame:
    """Flows with the sensor statistics of their bucket; gaps get the median over the joined rows.

    All flows of a bucket get the same statistics, so the medians come from the buckets weighted by their
    flow counts; the flows themselves are joined once.
    """
    joined = flows.join(buckets, list(on), "left")
    added = [c for c in buckets.columns if c not in on]
    if not fill:
        return joined
    counts = flows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    weighed = stage(buckets.join(counts, list(on)).select("_n", *added), "bucket-weights")
    long = weighed.unpivot(["_n"], added, "name", "x")
    medians = weighted_percentile(long, ["name"], "x", "_n", 0.5, "median")
    return _fill_from(joined, _one_row(medians, added), added)


def coverage(flows: DataFrame, flow_bucket: Column, buckets: DataFrame, bucket: str) -> DataFrame:
    """Share of flows whose bucket exists on the other side.

    Flows are counted per bucket before the join, so the join moves buckets and not flows.
    """
    left = flows.groupBy(flow_bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    right = buckets.select(F.col(bucket).alias("_b"), F.lit(1).alias("_hit")).distinct()
    return left.join(right, "_b", "left").agg(
        F.sum("_n").alias("n_flows"),
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("n_matched"),
    ).withColumn("coverage", F.col("n_matched") / F.col("n_flows"))


def with_count(windows: DataFrame, counts: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Look a count up per window, 0 where there is none."""
    return windows.join(counts, list(on), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def one_hot(
    df: DataFrame, col: str, values: Sequence[str] | None = None, missing: str = "unknown", most: int = 256, unseen: str = "error"
) -> DataFrame:
    """One 0/1 column per value, in the order of the values; null counts as ``missing``.

    Without ``values`` they are those of the column; more than ``most`` are an error. With them, a row of another value
    fails the query, or is zero in all columns with ``unseen="zero"``.
    """
    if unseen not in ("error", "zero"):
        raise ValueError("unseen is error or zero")
    filled = F.coalesce(F.col(col).cast("string"), F.lit(missing))
    if values is None:
        values = sorted(r[0] for r in df.select(filled).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{col} has more than {most} values")
    elif unseen == "error":
        strange = F.raise_error(F.concat(F.lit(f"{col} has a value without a column: "), filled)).cast("string")
        filled = F.when(filled.isin(*values), filled).otherwise(strange)
    return df.select("*", *[(filled == v).cast("int").alias(f"{col}_{v}") for v in values])


def fill_missing(df: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Nulls become zero, the mean or the median of the column."""
    if how == "zero":
        return df.fillna(0.0, list(cols))
    if how == "median":
        return fill_with_median(df, cols)
    return _fill_from(df, df.agg(*[F.avg(c).alias(c) for c in cols]), cols)
