import numpy as np
import pytest
from pyspark.sql import functions as F

from plantframe.functions import ranks
from plantframe.functions.columns import hash_order


@pytest.mark.parametrize("n", [5, 2_000, 60_000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, n, q):
    df = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.round(F.exp(F.rand(5) * 6), 2).alias("x")).persist()
    got = {r.k: r.p for r in ranks.exact_percentile(df, ["k"], "x", q, "p").collect()}
    for k, g in df.toPandas().groupby("k"):
        assert got[k] == pytest.approx(np.percentile(g["x"], 100 * q), rel=1e-12)
    df.unpersist()


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_percentiles_of_odd_values(spark, q, monkeypatch):
    """Many sizes and signs, denormal numbers, repeats, null keys, one value, infinite ends, and few bins."""
    monkeypatch.setattr(ranks, "BINS", 8)
    rng = np.random.default_rng(4)
    groups = {
        "sizes": [float(s * 10.0**e) for s in (-1, 1) for e in range(-300, 300, 7)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308],
        "repeats": [float(v) for v in rng.integers(0, 4, 300)], "one": [3.25], None: [float(v) for v in rng.normal(size=101)],
        "near": [1.0 + k * 2.0**-52 for k in range(40)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("sizes", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r.k: r.p for r in ranks.exact_percentile(df, ["k"], "x", q, "p").collect()}
    for k, vs in groups.items():
        vs, at = sorted(vs), q * (len(vs) - 1)
        part = at - int(at)
        want = vs[int(at)] if part == 0 else vs[int(at)] * (1 - part) + vs[int(at) + 1] * part
        assert got[k] == pytest.approx(want, rel=1e-15, abs=0)
    ends = spark.createDataFrame([("k", float(v)) for v in ("-inf", "1", "2", "inf", "nan")], "k string, x double")
    assert [ranks.exact_percentile(ends, ["k"], "x", p, "p").first()["p"] for p in (0.0, 0.25, 0.5)] == [float("-inf"), 1.0, 2.0]


def test_no_window_over_a_groups_rows(spark):
    """The only window is over bins."""
    df = spark.range(1000).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS x")
    assert "Window" not in ranks.exact_percentile(df, ["k"], "x", 0.5, "p")._jdf.queryExecution().toString()


def test_weighted_percentile(spark):
    rows = [("a", float(x), int(w)) for x, w in zip([3, 1, 2, 9, 2], [2, 1, 4, 1, 3])]
    df = spark.createDataFrame(rows, "k string, x double, w long")
    got = ranks.weighted_percentile(df, ["k"], "x", "w", 0.5, "p").first()["p"]
    assert got == np.median(np.repeat([3, 1, 2, 9, 2], [2, 1, 4, 1, 3]))


def test_running_total(spark):
    df = spark.range(1000).select(F.lit("f").alias("k"), (F.col("id") * 37 % 1000).cast("double").alias("v"), (F.col("id") % 5).alias("n"))
    got = ranks.running_total(df, ["k"], "v", ["n"]).toPandas().sort_values("v")
    np.testing.assert_array_equal(got["before_n"], got["n"].cumsum() - got["n"])


def test_split_takes_the_exact_share_of_every_class(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3 == 0).alias("y"))
    split = ranks.split_by_rank(df, ["y"], hash_order(42, "id"), 0.25)
    for r in split.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("held_out").cast("int")).alias("k")).collect():
        assert r.k == int(0.25 * r.n)


def test_top_rows_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("y"))
    top = ranks.top_rows(df, ["y"], [hash_order(1, "id")], 5)
    assert top.count() == 10
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
