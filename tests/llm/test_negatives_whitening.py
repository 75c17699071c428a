"""Hard negatives and whitening against plain computations."""

import math

import numpy as np
import pytest

from plantframe.llm import hardnegatives, whitening
from plantframe.session import stage

SCHEMA = "vec_id long, label int, embedding array<double>"
ODD = [
    (5000, None, [1.0] * 6), (5001, 1, None), (5002, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5003, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (5004, 1, []), (5005, 1, [1.0]),
    (5006, 2, [1e200] * 6), (5008, 2, [math.nan] * 6),
]


def plain_negatives(rows, chosen):
    rows = {(i, label, tuple(math.floor(256 * c) for c in v)) for i, label, v in rows}
    out = []
    for a in [r for r in rows if chosen(r[0])]:
        scores = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r != a]
        for p, positive, _ in sorted(s for s in scores if s[2] == a[1])[:5]:
            inside = sorted(s for s in scores if s[2] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a[0], positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    """Clusters, one vector that many rows share, ids that repeat, equal rows, a zero vector."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(9, 6))
    rows = []
    for i in range(1200):
        v = base[0] if i % 9 == 0 else base[rng.integers(9)] + 0.05 * rng.normal(size=6)
        rows.append((int(i if i % 11 else i // 2), int(rng.integers(4)), [float(c) for c in v]))
    return rows + rows[:5] + [(5050, 2, [0.0] * 6)]


@pytest.mark.parametrize("shape", [hardnegatives.Shape(), hardnegatives.Shape(sample=300, branches=5, leaf_rows=40, block_rows=50, block_queries=7)])
def test_hard_negatives(spark, clustered, shape):
    df = spark.createDataFrame(clustered + ODD, SCHEMA).repartition(4)
    got = hardnegatives.mine(df, df.filter("vec_id % 50 = 0"), shape=shape)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == plain_negatives(clustered, lambda i: i % 50 == 0)


def test_siblings_are_eliminated_but_no_row_of_an_annulus(spark, clustered):
    df = spark.createDataFrame(clustered, SCHEMA)
    tree = hardnegatives.build(stage(hardnegatives.integers(df, "vec_id", "label", "embedding", 256), "x"), hardnegatives.Shape(sample=300, branches=5, leaf_rows=40))
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in clustered])
    leaf, scores = tree.route(x), hardnegatives.products(x, x)
    lo, hi = (np.percentile(scores, p, axis=1).astype(np.int64) for p in (97, 99))
    window, visited = tree.visits(x, np.arange(len(x)), lo, hi)
    met = np.zeros((len(x), tree.leaves), bool)
    met[window, visited] = True
    assert met[np.nonzero((scores >= lo[:, None]) & (scores <= hi[:, None]))[0], leaf[np.nonzero((scores >= lo[:, None]) & (scores <= hi[:, None]))[1]]].all()
    assert tree.leaves > 20 and met.mean() < 0.7


def test_large_components_stay_exact():
    a, b = np.array([[1 << 27, 3]]), np.array([[1 << 27, 5], [-(1 << 27), 7]])
    assert hardnegatives.products(a, b).tolist() == [[(1 << 54) + 15, 21 - (1 << 54)]]


def test_no_vectors_and_clashing_names(spark, clustered):
    none = spark.createDataFrame([], SCHEMA)
    assert hardnegatives.mine(none, none).count() == 0 and whitening.whiten(none).count() == 0
    df = spark.createDataFrame(clustered[:300], SCHEMA).selectExpr("*", "1 AS id", "2 AS x", "3 AS h", "4 AS q", "5 AS leaf", "6 AS component", "7 AS n")
    plain = df.select("vec_id", "label", "embedding")
    for run in (lambda d: hardnegatives.mine(d, d.filter("vec_id % 20 = 0")), whitening.whiten):
        rows = [[sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in run(d).collect())] for d in (df, plain)]
        assert rows[0] == rows[1]


def compare_whitening(df, k=4):
    got = whitening.whiten(df, k).toPandas()
    rows = [(r.vec_id, [math.floor(256 * float(c)) for c in r.embedding]) for r in df.collect() if r.embedding and all(c is not None and abs(c) < 1e12 for c in r.embedding)]
    xs = sorted({tuple(x) for _, x in rows})
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    centred = np.array([[(a * n - s) / n for a, s in zip(x, sums)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors, k = values[::-1], vectors[:, ::-1], min(k, len(sums))
    assert len(got) == k * len(rows) and set(got.n) == {n}
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id, map(int, first.deviation))) == sorted((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in rows)
    for c in range(k):
        mine = got[got.component == c + 1].sort_values("vec_id", kind="stable")
        if values[c] > 1e-9 * values[0]:
            want = np.array([[a - s / n for a, s in zip(x, sums)] for _, x in sorted(rows)]) @ vectors[:, c] / math.sqrt(values[c])
            have = mine.whitened.to_numpy()
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
            assert abs(mine.explained.iloc[0] / (values[c] / values.sum()) - 1) < 1e-4
        else:
            assert mine.whitened.isna().all() or mine.explained.iloc[0] < 1e-9
    return got


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(c) for c in rng.normal(size=6) * [5, 3, 1, 1e3, 0.1, 2] + 7]) for i in range(400)]
    got = compare_whitening(spark.createDataFrame(rows + rows[:9] + ODD, SCHEMA).repartition(3).filter("vec_id <> 5005 AND vec_id < 5006 OR vec_id > 5006"))
    assert got.identity_error.max() < 1e-9


def test_whitening_of_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(200, 5))) / 256
    v[:, 4], v[:, 3] = 3 * v[:, 0], 0.5
    got = compare_whitening(spark.createDataFrame([(i, 0, [float(c) for c in r]) for i, r in enumerate(v)], SCHEMA), 5)
    assert got[got.component > 3].whitened.isna().all() and got.identity_error.max() < 1e-9


def test_whitening_of_one_vector(spark):
    got = compare_whitening(spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], SCHEMA))
    assert got.whitened.isna().all() and got.explained.isna().all()
