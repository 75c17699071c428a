"""Ward linkage of many rows: mergeable clustering features, then merging of reciprocal nearest pairs.

A clustering feature is the count, the sum and the sum of squares of some rows; two of them add up to that of both, so
tasks condense their rows and Spark merges what they find. Rows meet in the cell of their nearest seed, and the seeds
are refined in rounds; with no more distinct rows than cells each distinct row is a cell of its own, and the linkage is
that of plain Ward. The cells, bounded in number by a parameter, are then linked: Ward's distances can't fall by a
merge, so all pairs that are each other's nearest are merged in one round, and sorting by height gives the linkage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Cells that rows are condensed into at most; distances between them are held at once.
CELLS = 2000
ROUNDS = 3


def _nearest(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Number of the nearest seed of each row, the first of several."""
    middle = seeds.mean(axis=0)
    x, seeds = x - middle, seeds - middle
    out, square = np.zeros(len(x), np.int64), (seeds * seeds).sum(axis=1)
    for low in range(0, len(x), 4096):
        out[low : low + 4096] = (square - 2 * x[low : low + 4096] @ seeds.T).argmin(axis=1)
    return out


def assigned(rows: DataFrame, vec: str, seeds: np.ndarray, out: str = "cell") -> DataFrame:
    """Rows with the number of their nearest seed."""

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(_nearest(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1), seeds))

    return rows.withColumn(out, of(F.col(vec).cast("array<double>")))


def features(rows: DataFrame, vec: str, seeds: np.ndarray) -> DataFrame:
    """Clustering feature of each cell that has rows: ``cell``, ``n``, ``s`` (array) and ``q`` (sum of squared norms)."""

    def condense(batches):
        k, d = seeds.shape
        n, s, q = np.zeros(k, np.int64), np.zeros((k, d)), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = _nearest(x, seeds)
            np.add.at(s, cell, x)
            n += np.bincount(cell, minlength=k)
            q += np.bincount(cell, (x * x).sum(axis=1), k)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.float64())), pa.array(q[used])], ["cell", "n", "s", "q"])

    parts = rows.select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(condense, "cell long, n long, s array<double>, q double")
    each = parts.select("cell", "n", "q", F.posexplode("s").alias("i", "v")).groupBy("cell", "i").agg(F.sum("v").alias("v"))
    sums = each.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).join(sums, "cell").select("cell", "n", "s", "q")


def cells(rows: DataFrame, vec: str, most: int = CELLS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres and counts of at most ``most`` cells; the seeds are distinct rows in the order of a hash."""
    x = F.col(vec).cast("array<double>")
    drawn = rows.select(x.alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(most + 1).collect()
    seeds = np.array([r.x for r in drawn], float)
    whole = len(seeds) <= most
    seeds = seeds[:most]
    for _ in range(1 if whole else rounds):
        found = features(rows, vec, seeds).orderBy("cell").collect()  # a row for each cell
        counts = np.array([r.n for r in found])
        seeds = seeds[[r.cell for r in found]] if whole else np.array([r.s for r in found]) / counts[:, None]
    return seeds, counts


def linkage(centres: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Linkage of weighted points: the two clusters, their distance and the rows of both, by rising distance.

    Points are clusters 0 to m - 1, the cluster of line i is m + i. The distance of two clusters is the root of twice
    the rise of the sum of squares, as is usual for Ward.
    """
    m = len(centres)
    c, n = centres.astype(float).copy(), counts.astype(float).copy()
    square = ((c[:, None] - c[None]) ** 2).sum(axis=2) if m <= 256 else None
    if square is None:
        norm = (c * c).sum(axis=1)
        square = np.maximum(norm[:, None] + norm[None] - 2 * c @ c.T, 0)
    apart = square * (2 * n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(apart, np.inf)
    alive, name, merges, made = np.ones(m, bool), np.arange(m), [], m
    while alive.sum() > 1:
        at = np.flatnonzero(alive)
        near = at[apart[np.ix_(at, at)].argmin(axis=1)]
        to = np.full(m, -1)
        to[at] = near
        pairs = [(i, j) for i, j in zip(at.tolist(), near.tolist()) if i < j and to[j] == i]
        for i, j in pairs:
            height = apart[i, j]
            merges.append((name[i], name[j], height, n[i] + n[j], made))
            # distances to the union, by the formula of Lance and Williams
            rest = alive.copy()
            rest[[i, j]] = False
            k = np.flatnonzero(rest)
            apart[i, k] = ((n[i] + n[k]) * apart[i, k] + (n[j] + n[k]) * apart[j, k] - n[k] * height) / (n[i] + n[j] + n[k])
            apart[k, i] = apart[i, k]
            n[i], name[i], alive[j] = n[i] + n[j], made, False
            apart[j, :] = apart[:, j] = np.inf
            made += 1
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    number = {merges[i][4]: m + at for at, i in enumerate(order)}
    lines = [(*sorted(number.get(v, v) for v in merges[i][:2]), np.sqrt(max(merges[i][2], 0.0)), merges[i][3]) for i in order]
    return np.array(lines).reshape(-1, 4)


def cut(lines: np.ndarray, m: int, k: int) -> np.ndarray:
    """Cluster of each of m points when the linkage is cut into k, numbered by the smallest point."""
    root = np.arange(m + len(lines))
    for i, (a, b, _, _) in enumerate(lines[: max(m - k, 0)]):
        root[[int(a), int(b)]] = m + i
    for i in range(len(root) - 1, -1, -1):
        root[i] = root[root[i]]
    _, first, back = np.unique(root[:m], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def hierarchical(rows: DataFrame, vec: str, k: int, most: int = CELLS, out: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Rows with their Ward cluster of k, and the linkage: ``step``, ``a``, ``b``, ``distance``, ``n``.

    Rows in one cell share its cluster; see ``cells``. Equal rows are always together. An empty table has no linkage.
    """
    rows = stage(rows, "linked")
    if rows.isEmpty():
        return rows.withColumn(out, F.lit(None).cast("long")), rows.sparkSession.createDataFrame([], "step INT, a INT, b INT, distance DOUBLE, n LONG")
    centres, counts = cells(rows, vec, most)
    lines = linkage(centres, counts)
    of_cell = cut(lines, len(centres), k)
    names = F.array(*[F.lit(int(v)) for v in of_cell])
    table = [(i, int(a), int(b), float(d), int(n)) for i, (a, b, d, n) in enumerate(lines)]
    linked = rows.sparkSession.createDataFrame(table, "step INT, a INT, b INT, distance DOUBLE, n LONG")
    return assigned(rows, vec, centres, "_cell").withColumn(out, F.get(names, F.col("_cell").cast("int")).cast("long")).drop("_cell"), linked
