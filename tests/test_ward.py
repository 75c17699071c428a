"""Ward linkage against a plain one that merges the nearest pair at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantframe.operators import ward


def plain(x):
    groups, lines = {i: [i] for i in range(len(x))}, []
    rise = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
    while len(groups) > 1:
        d, i, j = min((rise(groups[i], groups[j]), i, j) for i in groups for j in groups if i < j)
        lines.append((i, j, d**0.5, len(groups[i]) + len(groups[j])))
        groups[len(x) + len(lines) - 1] = groups.pop(i) + groups.pop(j)
    return np.array(lines)


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_linkage_equals_plain_ward(seed):
    x = np.random.default_rng(seed).normal(size=(60, 3))
    got, want = ward.linkage(x, np.ones(60)), plain(x)
    assert np.allclose(got, want)


def test_rows_on_spark(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, size=(20, 2)) for c in (0, 5, 11)])
    rows, linked = ward.hierarchical(table(spark, x), "x", 3)
    got = {r.id: r.cluster for r in rows.collect()}
    assert len({(got[i], i // 20) for i in range(60)}) == 3
    lines = linked.orderBy("step").collect()
    assert np.allclose([r.distance for r in lines], plain(x)[:, 2]) and [r.n for r in lines] == plain(x)[:, 3].tolist()


def test_cells_and_repeats(spark):
    """More rows than cells: counts are whole, clusters as planted; equal rows stay together."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.5, size=(400, 2)) for c in (0, 9, 20)] + [np.zeros((300, 2))])
    df = table(spark, x)
    centres, counts = ward.cells(df, "x", 50)
    assert len(centres) <= 50 and counts.sum() == len(x)
    rows, linked = ward.hierarchical(df, "x", 3, 50)
    assert linked.agg(F.max("n")).first()[0] == len(x)
    got = {r.id: r.cluster for r in rows.collect()}
    planted = np.append(np.repeat([0, 1, 2], 400), np.zeros(300, int))
    assert len({(got[i], int(p)) for i, p in enumerate(planted)}) == 3 and len({got[i] for i in range(1200, 1500)}) == 1
    none, empty = ward.hierarchical(df.limit(0), "x", 3)
    assert none.count() == 0 and empty.count() == 0
    one, line = ward.hierarchical(df.limit(1), "x", 3)
    assert one.first().cluster == 0 and line.count() == 0
