"""Distances to a sample take bounded memory, whatever the number of rows."""

import tracemalloc
from functools import partial

import numpy as np
import pytest

from plantframe.operators import cluster


@pytest.mark.parametrize("sizes", [(3000, 2), (500, 4)])
def test_distances_to_a_sample_in_little_memory(monkeypatch, sizes):
    monkeypatch.setattr(cluster, "DISTANCES", 1 << 16)
    rng = np.random.default_rng(2)
    x, points = rng.normal(size=(3000, 4)), rng.normal(size=(sum(sizes), 4))
    state = [[] for _ in x]
    tracemalloc.start()
    for low, high in ((0, sizes[0]), (sizes[0], sum(sizes))):
        state = cluster._folded(list(x), state, points[low:high], np.zeros(high - low), partial(cluster._smallest, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = np.sort(np.sqrt(((x[:, None] - points[None]) ** 2).sum(2)), axis=1)[:, :4]
    assert np.allclose(state, every) and peak < 8e6  # all distances to 3,000 points would take 72 MB


def test_neighbour_distance_of_fewer_points_than_wanted(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id long, x array<double>")
    got = {r.id: r.knn_distance for r in cluster.neighbour_distance(df, "x", df, 4).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 2.0}
