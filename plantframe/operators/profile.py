"""Feature profiles and tests of which features separate classes.

Per-column statistics are expressions of one aggregate over the wide table, so a table is read once
whatever the number of columns; results are then turned to one row per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import few, join_keys, one_value
from ..functions.ranks import running_total
from ..session import stage


def per_column(df: DataFrame, cols: Sequence[str], stats: dict, keys: Sequence[str] = ()) -> DataFrame:
    """One row per column (and key) with the given statistics, from one aggregation."""
    packed = df.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"), *[fn(F.col(f"`{c}`")).alias(n) for n, fn in stats.items()]
                )
                for c in cols
            ]
        ).alias("_all")
    )
    return packed.select(*keys, F.explode("_all").alias("s")).select(*keys, "s.*")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("_t", one_value(total)).select(
        label, "n", (F.col("n") * 100.0 / F.col("_t.total")).alias("pct")
    )


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count and percentage of the columns that have any."""
    stats = {
        "n_null": lambda c: F.count(F.when(c.isNull(), 1)),
        "pct_null": lambda c: F.count(F.when(c.isNull(), 1)) * 100.0 / F.count(F.lit(1)),
    }
    return per_column(df, cols, stats).filter("n_null > 0")


def skew(df: DataFrame, cols: Sequence[str], above: float = 1.0) -> DataFrame:
    """Columns with a large bias-corrected skewness."""
    stats = {"g": F.skewness, "n": F.count}
    n = F.col("n").cast("double")
    corrected = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    return (
        per_column(df, cols, stats)
        .select("feature", corrected.alias("skew"))
        .filter(F.abs("skew") > above)
    )


def zero_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, {"zero_share": lambda c: F.avg(F.when(c == 0, 1.0).otherwise(0.0))})


def near_constant(df: DataFrame, cols: Sequence[str], below: float = 1e-6) -> DataFrame:
    return per_column(df, cols, {"std": F.stddev_samp}).filter(F.col("std") < below)


def top_variance(df: DataFrame, cols: Sequence[str], n: int = 20) -> DataFrame:
    return (
        per_column(df, cols, {"variance": F.var_samp}).orderBy(F.desc("variance"), "feature").limit(n)
    )


def histogram(df: DataFrame, cols: Sequence[str], label: str, bins: int) -> DataFrame:
    """Density per class over equal bins of that class's own range, the last bin closed; null values don't count.

    Limits are one row for each class. Rows meet them as they are, and tasks count their bins: only bins are shuffled.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    limits = df.groupBy(label).agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("total")).alias(f"_l{i}") for i, v in enumerate(x.values())])
    met = join_keys(df.select(label, *[v.alias(c) for c, v in x.items()]), few(limits, "limits"), [label])
    each = []
    for i, c in enumerate(cols):
        low, high, value = F.col(f"_l{i}.lo"), F.col(f"_l{i}.hi"), F.col(f"`{c}`")
        # a constant feature gets a unit range around its value
        start = F.when(high > low, low).otherwise(low - 0.5)
        width = F.when(high > low, (high - low) / bins).otherwise(1.0 / bins)
        number = F.least(F.floor((value - start) / width), F.lit(bins - 1)).cast("int")
        each.append(F.when(value.isNotNull(), F.struct(F.lit(c).alias("feature"), number.alias("bin"), F.col(f"_l{i}.total").alias("total"), width.alias("width"))))
    counted = met.select(label, F.explode(F.array_compact(F.array(*each))).alias("_b")).groupBy(label, "_b.feature", "_b.bin")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.first("_b.total").alias("total"), F.first("_b.width").alias("width"))
    return counted.select(label, "feature", "bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def density_over_time(alerts: DataFrame, elapsed: str, kind: str, edges: int = 100) -> DataFrame:
    """Counts per kind in ``edges - 1`` equal bins from 0 to the largest elapsed time."""
    last = alerts.agg(F.max(elapsed).alias("hi"))
    width = F.col("_w.hi") / (edges - 1)
    return (
        alerts.withColumn("_w", one_value(last))
        .withColumn("bin", F.least(F.floor(F.col(elapsed) / width), F.lit(edges - 2)).cast("int"))
        .groupBy(kind, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Class codes in alphabetical order from 0. One row per class."""
    classes = df.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("_all"))
    return classes.select(F.posexplode("_all").alias("code", label))


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are known; null without spread.

    One pass finds the means, a second one sums for blocks of rows the products of centred values, their squares and
    what is present, for all pairs at once as products of matrices. Nulls and NaN are missing values.
    """
    wide = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)])
    middle = np.array([v or 0.0 for v in wide.agg(*[F.avg(c) for c in wide.columns]).first()])
    names = ("n", "sa", "sb", "qa", "qb", "p")

    def products(batches):
        total = np.zeros((len(names), len(middle), len(middle)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            x, m = np.where(there, x - middle, 0.0), there.astype(float)
            s, q = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, s, s.T, q, q.T, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(middle)), pa.int32())] + [pa.array(list(t), pa.list_(pa.float64())) for t in total], ["i", *names])

    parts = wide.mapInArrow(products, "i int, " + ", ".join(f"{n} array<double>" for n in names))
    sums = parts.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "v")).groupBy("i", "j").agg(*[F.sum(f"v.{n}").alias(n) for n in names])
    ends = F.array(*[F.lit(float(v)) for v in middle])
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = {k: F.col(f"q{k}") / n - (F.col(f"s{k}") / n) * (F.col(f"s{k}") / n) for k in "ab"}
    # what rounding of the mean leaves of a constant column is no spread
    varies = [spread[k] > F.pow(F.get(ends, F.col(i)) * 1e-14, 2) for k, i in (("a", "i"), ("b", "j"))]
    r = (F.col("p") / n - F.col("sa") / n * F.col("sb") / n) / F.nullif(F.sqrt(F.greatest(spread["a"] * spread["b"], F.lit(0.0))), F.lit(0.0))
    title = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        F.get(title, F.col("i")).alias("a"), F.get(title, F.col("j")).alias("b"), F.when(varies[0] & varies[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r")
    )


def correlation_with_label(df: DataFrame, cols: Sequence[str], label: str, n: int) -> DataFrame:
    """The n columns with the largest absolute correlation with the class code."""
    coded = df.join(label_codes(df, label), label)
    return (
        per_column(coded, cols, {"r": lambda c: F.corr(c, F.col("code"))})
        .withColumn("abs_r", F.abs("r"))
        .orderBy(F.desc("abs_r"), "feature")
        .limit(n)
    )


def ols_by_class(
    df: DataFrame, label: str, pairs: Sequence[tuple[str, str]], least: int = 10
) -> DataFrame:
    """Slope, intercept and r per class and pair of columns; thin or constant groups are left out."""
    rows = []
    for x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        fx = F.when(both, F.col(x).cast("double"))
        rows.append(
            F.struct(
                F.lit(x).alias("x"), F.lit(y).alias("y"), F.count(fx).alias("n"),
                (F.max(fx) > F.min(fx)).alias("varies"),
                F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                F.corr(F.col(x), F.col(y)).alias("r"),
            )
        )
    return (
        df.groupBy(label).agg(F.array(*rows).alias("_all"))
        .select(label, F.explode("_all").alias("p"))
        .filter((F.col("p.n") >= least) & F.col("p.varies"))
        .select(label, "p.x", "p.y", "p.n", "p.slope", "p.intercept", "p.r")
    )


def cronbach_alpha(df: DataFrame, groups: dict[str, Sequence[str]], split: Column, name: str = "part") -> DataFrame:
    """Internal consistency of column groups per part of the table; rows with a null are left out."""

    def alpha(cols: Sequence[str]) -> Column:
        k = len(cols)
        if k < 2:
            return F.lit(None).cast("double")
        whole = F.lit(True)
        total = F.lit(0.0)
        for c in cols:
            whole = whole & F.col(c).isNotNull()
            total = total + F.col(c)
        var_total = F.var_samp(F.when(whole, total))
        var_each = sum((F.var_samp(F.when(whole, F.col(c))) for c in cols), F.lit(0.0))
        return F.when(var_total > 0, F.lit(k / (k - 1)) * (1 - var_each / var_total))

    packed = df.groupBy(split.alias(name)).agg(
        F.array(
            *[
                F.struct(F.lit(g).alias("group"), F.lit(len(cols)).alias("k"), alpha(cols).alias("alpha"))
                for g, cols in groups.items()
            ]
        ).alias("_all")
    )
    return packed.select(name, F.explode("_all").alias("s")).select(name, "s.*")


def _tails(kind: str):
    @F.pandas_udf(T.DoubleType())
    def normal(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))

    @F.pandas_udf(T.DoubleType())
    def chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([_chi2_tail(a, int(k)) for a, k in zip(x, dof)])

    return {"normal": normal, "chi2": chi2}[kind]


def _chi2_tail(x: float, dof: int) -> float | None:
    """P(chi-square > x) for whole degrees of freedom, by its finite sum."""
    if dof < 1 or x is None or math.isnan(x):
        return None
    half = x / 2.0
    if half <= 0:
        return 1.0
    # each term in logs: exp(-x / 2) alone is zero for large x
    if dof % 2 == 0:
        tail, start = 0.0, 0.0
    else:
        tail, start = math.erfc(math.sqrt(half)), 0.5
    for i in range(dof // 2):
        power = i + start
        tail += math.exp(power * math.log(half) - half - math.lgamma(power + 1))
    return min(1.0, tail)


def mann_whitney(
    df: DataFrame, cols: Sequence[str], is_attack: Column, n: int = 20, least: int = 5
) -> DataFrame:
    """Rank comparison of two parts per feature: U, effect |2U/(n1 n0) - 1| and the two-sided p-value.

    Rows are first counted per distinct value, which also settles ties (equal values share the mean
    rank); p is the normal approximation with tie and continuity correction.
    """
    counts = (
        df.select(is_attack.cast("int").alias("_a"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
        .unpivot(["_a"], list(cols), "feature", "v")
        .filter("v IS NOT NULL AND _a IS NOT NULL")
        .groupBy("feature", "v")
        .agg(F.sum("_a").alias("n1"), F.sum(1 - F.col("_a")).alias("n0"))
    )
    placed = running_total(stage(counts, "value-counts"), ["feature"], "v", ["n0"])
    ties = (F.col("n1") + F.col("n0")).cast("double")
    sums = placed.groupBy("feature").agg(
        F.sum(F.col("n1") * (F.col("before_n0") + F.col("n0") / 2.0)).alias("u"),
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(ties * ties * ties - ties).alias("ties"),
    ).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    product = F.col("n1").cast("double") * F.col("n0")
    total = (F.col("n1") + F.col("n0")).cast("double")
    spread = F.sqrt(product / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    z = F.greatest(F.abs(F.col("u") - product / 2.0) - 0.5, F.lit(0.0)) / F.nullif(spread, F.lit(0.0))
    return (
        sums.withColumn("effect", F.abs(2 * F.col("u") / product - 1))
        .withColumn("z", z)
        .orderBy(F.desc("effect"), "feature")
        .limit(n)
        .withColumn("p_value", _tails("normal")("z"))
        .withColumn("neg_log10_p", -F.log10(F.greatest("p_value", F.lit(1e-300))))
        .select("feature", "n1", "n0", "u", "effect", "z", "p_value", "neg_log10_p")
    )


def chi_square(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Chi-square of each category column against the class, with Cramér's V.

    Empty cells add nothing to the sum of O^2/(row*column), so only cells that occur are needed. With
    one degree of freedom the continuity correction is applied.
    """
    long = df.select(label, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [label], list(cols), "feature", "category"
    ).filter(F.col("category").isNotNull() & F.col(label).isNotNull())
    cell = long.groupBy("feature", "category", label).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cell.groupBy("feature", "category").agg(F.sum("o").alias("r"))
    columns = cell.groupBy("feature", label).agg(F.sum("o").alias("c"))
    n_rows = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("n"), F.sum(1 / F.col("r")).alias("inv_r")
    )
    n_cols = columns.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c")
    )
    joined = cell.join(rows, ["feature", "category"]).join(columns, ["feature", label]).join(n_rows, "feature")
    expected = F.col("r") * F.col("c") / F.col("n")
    stat = (
        joined.groupBy("feature")
        .agg(
            F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
            F.max(F.abs(F.col("o") - expected)).alias("gap"),
        )
        .join(n_rows, "feature")
        .join(n_cols, "feature")
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    gap = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = gap * gap * F.col("n") * F.col("inv_r") * F.col("inv_c")
    plain = F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))
    shape = F.least("n_rows", "n_cols") - 1
    return (
        stat.withColumn("dof", dof)
        .withColumn("chi2", F.when(F.col("dof") == 1, corrected).otherwise(plain))
        .withColumn("cramers_v", F.when(shape > 0, F.sqrt(F.col("chi2") / (F.col("n") * shape))))
        .withColumn("p_value", _tails("chi2")("chi2", "dof"))
        .select("feature", "chi2", "dof", "p_value", "cramers_v")
    )


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(n)


def crosstab_share(df: DataFrame, col: str, label: str, n: int = 10) -> DataFrame:
    """Share of each class within the most frequent values of a category."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(col).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), col).limit(n)
    return counts.join(top, col).select(col, label, "n", (F.col("n") / F.col("total")).alias("share"))


def variance_by_part(df: DataFrame, cols: Sequence[str], attack: Column) -> DataFrame:
    """Variance of each column on normal and on attack rows, and their ratio (infinite over 0)."""
    stats = {
        "var_normal": lambda c: F.var_samp(F.when(~attack, c)),
        "var_attack": lambda c: F.var_samp(F.when(attack, c)),
    }
    return per_column(df, cols, stats).withColumn(
        "ratio",
        F.when(F.col("var_normal") > 0, F.col("var_attack") / F.col("var_normal")).otherwise(
            F.lit(float("inf"))
        ),
    )
