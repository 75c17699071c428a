"""Sliced operators against plain pandas, for several slice lengths and shuffled input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantframe.functions import ordered

S = 1_000_000


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 400
    df = pd.DataFrame(
        {
            "k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "t_us": rng.integers(0, 300, n) * S // 2,
            "row_id": np.arange(n),
            "value": rng.normal(0, 1, n).round(3),
        }
    )
    df["flag"] = rng.random(n) < 0.5
    df["hole"] = df["value"].where(rng.random(n) < 0.3)
    return df


def make(spark, rows):
    shuffled = rows.sample(frac=1, random_state=3)
    data = [tuple(None if isinstance(v, float) and np.isnan(v) else v.item() if hasattr(v, "item") else v for v in r) for r in shuffled.itertuples(index=False)]
    return spark.createDataFrame(data, "k string, t_us long, row_id long, value double, flag boolean, hole double").repartition(5)


@pytest.mark.parametrize("slice_s", [1, 20, 1000])
def test_previous_ordinal_fill(spark, rows, slice_s):
    df = make(spark, rows)
    want = rows.sort_values(["k", "t_us", "row_id"]).copy()
    want["prev"] = want.groupby("k")["value"].shift()
    want["ord"] = want.groupby("k").cumcount()
    want["filled"] = want.groupby("k")["hole"].ffill()
    want = want.set_index("row_id").sort_index()
    a = ordered.previous_row(df, ["k"], "t_us", "row_id", ["value"], slice_s).toPandas().set_index("row_id").sort_index()
    b = ordered.row_ordinal(df, ["k"], "t_us", "row_id", slice_s).toPandas().set_index("row_id").sort_index()
    c = ordered.carry_forward(df, ["k"], "t_us", "row_id", "hole", slice_s, "filled").toPandas().set_index("row_id").sort_index()
    np.testing.assert_array_equal(a["prev_value"], want["prev"])
    np.testing.assert_array_equal(b["ord"], want["ord"])
    np.testing.assert_array_equal(c["filled"], want["filled"])


@pytest.mark.parametrize("slice_s", [None, 50])
def test_range_frame(spark, rows, slice_s):
    got = ordered.sliding_variance(
        make(spark, rows), ["k"], "t_us", "value", 20, 5, slice_s, "n", "v"
    ).toPandas().set_index("row_id").sort_index()
    assert len(got) == len(rows)
    for r in rows.itertuples():
        near = rows[(rows.k == r.k) & (rows.t_us >= r.t_us - 20 * S) & (rows.t_us <= r.t_us + 5 * S)]["value"]
        assert got.loc[r.row_id, "n"] == len(near)
        assert got.loc[r.row_id, "v"] == pytest.approx(near.var(ddof=0), abs=1e-9)


def test_rolling_edge(spark):
    df = spark.createDataFrame([("a", t * S, i, v) for i, (t, v) in enumerate([(0, 1.0), (10, 2.0), (60, 5.0), (71, 5.0)])], "k string, t_us long, row_id long, value double")
    got = ordered.sliding_variance(df, ["k"], "t_us", "value", 60, variance="v").orderBy("t_us").toPandas()["v"]
    np.testing.assert_allclose(got, [0, 0.25, 2.888889, 0], atol=1e-6)


@pytest.mark.parametrize("slice_s", [1, 30, 5000])
def test_segments(spark, rows, slice_s):
    want = []
    for k, g in rows.sort_values(["t_us", "row_id"]).groupby("k"):
        on = g["flag"].to_numpy()
        start = None
        for i, v in enumerate([*on, False]):
            if v and start is None:
                start = i
            if not v and start is not None:
                want.append((k, start, i - 1))
                start = None
    got = ordered.segments(make(spark, rows), ["k"], "t_us", "row_id", "flag", slice_s)
    assert sorted((r.k, r.start_ord, r.end_ord) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("flags,want", [([0, 1, 1, 0, 1, 0, 0], [(1, 2), (4, 4)]), ([1, 1, 1, 1], [(0, 3)]), ([0, 0, 1], [(2, 2)]), ([0, 0], [])])
def test_segment_edges(spark, flags, want):
    df = spark.createDataFrame([("s", i * S, i, bool(f)) for i, f in enumerate(flags)], "k string, t_us long, row_id long, flag boolean")
    got = ordered.segments(df, ["k"], "t_us", "row_id", "flag", 2)
    assert sorted((r.start_ord, r.end_ord) for r in got.collect()) == want


@pytest.mark.parametrize("slice_s", [None, 5, 17, 10_000])
def test_cooldown_matches_the_greedy_rule(spark, rows, slice_s):
    want = []
    for _, g in rows.sort_values(["t_us", "row_id"]).groupby("k"):
        last = None
        for r in g.itertuples():
            if last is None or r.t_us - last >= 5 * S:
                want.append(r.row_id)
                last = r.t_us
    got = ordered.cooldown(make(spark, rows), ["k"], "t_us", "row_id", 5, slice_s)
    assert sorted(r.row_id for r in got.collect()) == sorted(want)


def test_cooldown_edge(spark):
    times = [0, 3, 5, 7, 9.9, 10, 20]
    df = spark.createDataFrame([("a", int(t * S), i) for i, t in enumerate(times)], "k string, t_us long, row_id long")
    got = ordered.cooldown(df, ["k"], "t_us", "row_id", 5, 6)
    assert sorted(r.t_us // S for r in got.collect()) == [0, 5, 10, 20]


@pytest.mark.parametrize("slice_s", [3, 1000])
def test_first_rows(spark, rows, slice_s):
    got = ordered.first_rows(make(spark, rows), ["k"], "t_us", "row_id", F.greatest(F.lit(10), F.floor(0.15 * F.col("n"))), slice_s)
    want = []
    for _, g in rows.sort_values(["t_us", "row_id"]).groupby("k"):
        want += g["row_id"].head(max(10, int(0.15 * len(g)))).tolist()
    assert sorted(r.row_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("slice_s", [None, 2, 50])
def test_cooldown_of_one_dense_key(spark, slice_s):
    """Slices as long as the gap, or of many gaps, cut one crowded history alike."""
    t = np.sort(np.random.default_rng(3).integers(0, 200 * S, 5000))
    df = spark.createDataFrame([("k", int(x), i) for i, x in enumerate(t)], "k string, t_us long, row_id long")
    want, last = [], None
    for x in t.tolist():
        if last is None or x >= last + 2 * S:
            want.append(x)
            last = x
    got = ordered.cooldown(df, ["k"], "t_us", "row_id", 2, slice_s)
    assert sorted(r.t_us for r in got.collect()) == want


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(k, i * 10 * S, i, v) for i, (k, v) in enumerate([(None, 1.0), ("a", 2.0), (None, None), ("a", None), (None, 3.0)])], "k string, t_us long, row_id long, v double")
    for slice_s in (5, 1000):
        assert sorted(r.ord for r in ordered.row_ordinal(df, ["k"], "t_us", "row_id", slice_s).collect()) == [0, 0, 1, 1, 2]
        before = {r.row_id: r.prev_v for r in ordered.previous_row(df, ["k"], "t_us", "row_id", ["v"], slice_s).collect()}
        assert before == {0: None, 1: None, 2: 1.0, 3: 2.0, 4: None}
        filled = {r.row_id: r.f for r in ordered.carry_forward(df, ["k"], "t_us", "row_id", "v", slice_s, "f").collect()}
        assert filled == {0: 1.0, 1: 2.0, 2: 1.0, 3: 2.0, 4: 3.0}
        assert sorted(r.row_id for r in ordered.first_rows(df, ["k"], "t_us", "row_id", F.lit(2), slice_s).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("slice_s", [None, 1, 90, 4000])
@pytest.mark.parametrize("before, after", [(60, 0), (20, 35)])
def test_sliding_frames(spark, slice_s, before, after):
    """Against plain loops: ties, gaps, constant stretches, nulls in value and key."""
    rng = np.random.default_rng(12)
    rows, t = [], 0
    for i in range(500):
        t += int(rng.choice([0, 1, 7, 40, 300])) * 1_000_000 // 2
        v = 5.0 if 100 < i < 160 else float(rng.normal(1000, 3))
        rows.append((i, [None, "a", "b"][i % 3], t, None if i % 17 == 0 else v))
    df = spark.createDataFrame(rows, "id long, k string, t_us long, value double").repartition(4)
    got = {r.id: r for r in ordered.sliding_variance(df, ["k"], "t_us", "value", before, after, slice_s).collect()}
    counts = {r.id: r.n for r in ordered.sliding_count(df, ["k"], "t_us", F.col("value") > 1000, before, after, slice_s).collect()}
    assert len(got) == len(counts) == len(rows)
    for i, k, t, _ in rows:
        frame = [v for _, k2, t2, v in rows if k2 == k and t - before * 1_000_000 <= t2 <= t + after * 1_000_000 and v is not None]
        assert got[i].n_window == len(frame) and counts[i] == sum(v > 1000 for v in frame)
        if not frame:
            assert got[i].rolling_var is None
        elif len(set(frame)) == 1:
            assert got[i].rolling_var == 0.0
        else:
            assert abs(got[i].rolling_var - np.var(frame)) < 1e-9 * max(1, np.var(frame))


def test_sliding_frames_take_linear_time(spark):
    """Twenty times as many rows in the same time take well under the square of that."""
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("id", "id % 2 AS k", f"id * {3_600_000_000 // n} AS t_us", "CAST(id % 97 AS DOUBLE) AS value")
        at = time.perf_counter()
        ordered.sliding_variance(df, ["k"], "t_us", "value", 1800).agg(F.sum("n_window"), F.sum("rolling_var")).collect()
        return time.perf_counter() - at

    seconds(1000)
    assert seconds(400_000) < 60 * max(seconds(20_000), 0.3)


def test_tasks_of_a_sliding_variance_grow_with_the_rows(spark, monkeypatch):
    from plantframe.functions import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 20)
    rows = [(i % 2, i // 2 * 1_000_000, float(i * i % 17) if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    out = ordered.sliding_variance(df, ["k"], "t", "v", 30, 10)
    assert out.rdd.getNumPartitions() == 20 and out.columns == ["k", "t", "v", "n_window", "rolling_var"]
    for r in out.collect():
        near = [v for k, t, v in rows if k == r.k and v is not None and -30_000_000 <= t - r.t <= 10_000_000]
        assert r.n_window == len(near) and abs(r.rolling_var - np.var(near)) < 1e-9
