"""Clustering without labels, and how good the clusters are.

Neighbour searches compare every row with a *sample* whose size is a parameter. It travels to the tasks in blocks of
bounded size, one after the other, and each row keeps what it needs of the blocks so far. Rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip_log1p, one_value
from ..session import stage
from .align import fill_with_median
from .profile import per_column, skew
from .sampling import fixed_size

BLOCK_ROWS = 20_000  # sample rows that are sent to all tasks at once
DISTANCES = 1 << 19  # distances that a task has at once


# ---- features --------------------------------------------------------------------------------


def feature_matrix(
    df: DataFrame, cols: Sequence[str], log_above: float = 2.0, out: str = "features"
) -> DataFrame:
    """Median for nulls, log1p where the skew is large, then mean 0 and deviation 1."""
    filled = stage(fill_with_median(df, cols), "filled")
    skewed = {r["feature"] for r in skew(filled, cols, log_above).select("feature").collect()}
    ready = filled.select(
        *[
            clip_log1p(F.col(c)).alias(c) if c in skewed else F.col(c)
            for c in df.columns
        ]
    )
    assembled = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(ready)
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withMean=True)
    return scaler.fit(assembled).transform(assembled).drop("_raw")


def components(df: DataFrame, k: int, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows with k principal components, and the explained share per component."""
    model = PCA(k=k, inputCol=features, outputCol="pcs").fit(df)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return model.transform(df), df.sparkSession.createDataFrame(shares, "component INT, explained DOUBLE")


def cumulative_share(shares: DataFrame, enough: float = 0.95) -> DataFrame:
    """Running sum of explained shares and the first component that reaches ``enough``.

    One row per component, so the order is over a handful of rows.
    """
    line = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    run = shares.withColumn("cumulative", F.sum("explained").over(line))
    needed = F.min(F.when(F.col("cumulative") >= enough, F.col("component"))).over(Window.partitionBy())
    return run.withColumn("n_needed", needed)


# ---- neighbours in a sample ----------------------------------------------------------


def _blocks(sample: DataFrame, vec: str, extra: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sample's vectors and one more column, in blocks."""
    rows = sample.select(vec, extra).toLocalIterator()
    while block := list(islice(rows, BLOCK_ROWS)):
        yield np.array([r[0] for r in block], dtype=float), np.array([r[1] for r in block])


def _folded(x: Sequence, state: Sequence, points: np.ndarray, more: np.ndarray, fn) -> list:
    """The rows' new states by one block of the sample, a few rows at a time."""
    middle = points.mean(axis=0)  # far from the origin, squares of plain coordinates lose digits
    points = points - middle
    squares, step, parts = (points**2).sum(1), max(1, DISTANCES // max(1, len(points))), []
    for at in range(0, len(x), step):
        rows = np.stack(x[at : at + step]).astype(float) - middle
        d = rows @ points.T
        d *= -2
        d += (rows**2).sum(1)[:, None] + squares[None, :]
        parts.extend(fn(np.sqrt(np.maximum(d, 0.0, out=d), out=d), list(state[at : at + step]), more))
    return parts


def _fold(df: DataFrame, vec: str, sample: DataFrame, extra: str, out: str, fn) -> DataFrame:
    """Call ``fn(distances, state, extra)`` per batch of rows and block of the sample.

    It gives the rows' new state, a list of numbers for each row; before the first block a state is empty. A state
    must not be a view of the distances, which would stay as long as it does.
    """
    spark = df.sparkSession
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.withColumn(out, F.array().cast("array<double>"))
    for block in _blocks(sample, vec, extra):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf[out] = _folded(pdf[vec].to_numpy(), pdf[out].to_numpy(), *shared.value, fn)
                yield pdf

        rows = rows.mapInPandas(run, f"{kept}, `{out}` array<double>")
    return rows


def _smallest(k: int, d: np.ndarray, state: list, _) -> list:
    if d.shape[1] > k:
        d.partition(k - 1, axis=1)
    every = np.concatenate([np.stack(state), d[:, :k]], axis=1)
    return list(np.sort(every, axis=1)[:, :k].copy())


def neighbour_distance(
    df: DataFrame, vec: str, sample: DataFrame, k: int = 4, out: str = "knn_distance"
) -> DataFrame:
    """Distance to the k-th nearest sample row. A row of the sample counts itself as the first."""
    found = _fold(df, vec, sample.withColumn("_none", F.lit(0)), "_none", out, partial(_smallest, k))
    return found.withColumn(out, F.array_max(out))


def nearest_label(
    df: DataFrame, vec: str, sample: DataFrame, label: str, out: str = "cluster"
) -> DataFrame:
    """The label, a whole number, of the nearest sample row."""

    def nearer(d: np.ndarray, state: list, labels: np.ndarray) -> list:
        at = d.argmin(1)
        new = zip(d[np.arange(len(d)), at].tolist(), labels[at].tolist())
        return [[a, float(b)] if not len(old) or a < old[0] else old for (a, b), old in zip(new, state)]

    return _fold(df, vec, sample, label, out, nearer).withColumn(out, F.get(out, 1).cast("long"))


def knee(curve: DataFrame, distance: str = "knn_distance", tie: str = "row_id") -> DataFrame:
    """The distance at which the falling curve bends most within its first half.

    The bend is the central difference applied twice, one-sided at the ends. The curve is over a bounded
    sample, so one order over it is small.
    """
    line = Window.orderBy(F.desc(distance), tie)
    ranked = curve.select(distance, tie, F.row_number().over(line).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))

    def gradient(df: DataFrame, col: str, out: str) -> DataFrame:
        w = Window.orderBy("i")
        back, ahead, here = F.lag(col).over(w), F.lead(col).over(w), F.col(col)
        return df.withColumn(
            out,
            F.when(back.isNull(), ahead - here).when(ahead.isNull(), here - back).otherwise((ahead - back) / 2),
        )

    bent = gradient(gradient(ranked, distance, "_d1"), "_d1", "_d2")
    half = bent.filter(F.col("i") <= F.floor(F.col("n") / 2))
    return half.agg(
        F.min(F.struct((-F.col("_d2")).alias("b"), F.col("i"), F.col(distance).alias("d"))).alias("_k")
    ).select(F.col("_k.d").alias("eps"))


def density_clusters(
    sample: DataFrame, vec: str, row_id: str, eps: float, min_points: int = 10
) -> DataFrame:
    """Density clusters of a bounded sample, noise is -1.

    A row with at least ``min_points`` rows within ``eps``, itself included, is a core row. Core rows
    within ``eps`` of each other share a cluster; other rows join the cluster of their first core
    neighbour. Clusters are named by their smallest core row.
    """

    def within(d: np.ndarray, state: list, ids: np.ndarray) -> list:
        return [np.concatenate([old, ids[row <= eps]]) for row, old in zip(d, state)]

    near = _fold(sample.select(row_id, vec), vec, sample, row_id, "near", within).select(
        F.col(row_id).alias("src"), F.col("near").cast("array<long>").alias("near")
    )
    near = stage(near, "neighbours")
    core = near.filter(F.size("near") >= min_points).select("src")
    edges = stage(
        near.select("src", F.explode("near").alias("dst")).join(
            core.select(F.col("src").alias("dst")), "dst"
        ),
        "edges",
    )
    core_edges = edges.join(core, "src")
    label = core.select("src", F.col("src").alias("c"))
    while True:
        # smallest label among the neighbours, then a jump to that label's own label
        spread = core_edges.join(label.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(
            F.min("c").alias("c")
        )
        jumped = spread.join(
            spread.select(F.col("src").alias("c"), F.col("c").alias("c2")), "c"
        ).select("src", F.least("c", "c2").alias("c"))
        fresh = stage(jumped, "labels")
        changed = fresh.join(label.withColumnRenamed("c", "was"), "src").filter("c <> was").limit(1).count()
        label = fresh
        if not changed:
            break
    border = (
        edges.join(core, "src", "left_anti")
        .groupBy("src")
        .agg(F.min("dst").alias("dst"))
        .join(label.withColumnRenamed("src", "dst"), "dst")
        .select("src", "c")
    )
    known = label.unionByName(border)
    return sample.join(known.withColumnRenamed("src", row_id), row_id, "left").select(
        *sample.columns, F.coalesce("c", F.lit(-1)).cast("long").alias("cluster")
    )


def density_clusters_for_all(
    df: DataFrame, vec: str, row_id: str, sample_size: int = 5000, min_points: int = 10, seed: int = 42
) -> DataFrame:
    """Cluster a sample by density, radius from the knee of its neighbour curve; then give every row the
    cluster of its nearest sample row."""
    sample = stage(fixed_size(df.select(row_id, vec), [row_id], sample_size, seed), "sample")
    curve = neighbour_distance(sample, vec, sample, 4)
    eps = knee(curve, "knn_distance", row_id).first()["eps"]
    named = density_clusters(sample, vec, row_id, float(eps), min_points)
    return nearest_label(df, vec, stage(named, "clusters"), "cluster")


def density_outliers(
    df: DataFrame, vec: str, row_id: str, sample_size: int = 5000, k: int = 5, cut: float = 0.95, seed: int = 42
) -> DataFrame:
    """Mark rows whose distance to the k-th sample neighbour is above the given percentile."""
    sample = stage(fixed_size(df.select(row_id, vec), [row_id], sample_size, seed), "sample")
    scored = neighbour_distance(df, vec, sample, k, "core_distance")
    limit = scored.agg(F.percentile_approx("core_distance", cut, 10_000).alias("v"))
    return scored.withColumn("_l", one_value(limit)).select(
        *df.columns, "core_distance", (F.col("core_distance") > F.col("_l.v")).alias("outlier")
    )


# ---- models ----------------------------------------------------------------------------------


def kmeans_scan(df: DataFrame, ks: Sequence[int], features: str = "features", seed: int = 42) -> DataFrame:
    """Cost and silhouette (squared Euclidean) per k, the best k marked."""
    cached = df.select(features).persist()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=features).fit(cached)
        score = ClusteringEvaluator(featuresCol=features).evaluate(model.transform(cached))
        rows.append((k, float(model.summary.trainingCost), float(score)))
    cached.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows], "k INT, cost DOUBLE, silhouette DOUBLE, best BOOLEAN"
    )


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42, out: str = "cluster") -> DataFrame:
    return kmeans_centres(df, k, features, seed, out)[0]


def kmeans_centres(df: DataFrame, k: int, features: str = "features", seed: int = 42, out: str = "cluster") -> tuple[DataFrame, np.ndarray]:
    """Rows with their cluster, and the centres, at most k."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out).fit(df)
    return model.transform(df), np.array(model.clusterCenters())


def centre_distances(rows: DataFrame, centres: np.ndarray, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Rows with the squared distances to their own centre, ``own2``, and to the nearest one, ``least2``."""
    x = vector_to_array(features)
    each = F.array(*[_distance2(x, F.array(*[F.lit(float(v)) for v in c])) for c in centres])
    return rows.withColumn("_d", each).withColumn("own2", F.get("_d", F.col(cluster))).withColumn("least2", F.array_min("_d")).drop("_d")


# ---- quality ---------------------------------------------------------------------------------


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    cell = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    pairs = lambda c: c * (c - 1) / 2
    side = {}
    for name in (a, b):
        side[name] = cell.groupBy(*keys, name).agg(F.sum("o").alias("m"))
    total = cell.groupBy(*keys).agg(F.sum("o").alias("n"), F.sum(pairs(F.col("o"))).alias("pij"))
    entropy_terms = F.sum(F.col("m") * F.log("m"))
    pa = side[a].groupBy(*keys).agg(F.sum(pairs(F.col("m"))).alias("pa"), entropy_terms.alias("la"), F.count(F.lit(1)).alias("ka"))
    pb = side[b].groupBy(*keys).agg(F.sum(pairs(F.col("m"))).alias("pb"), entropy_terms.alias("lb"), F.count(F.lit(1)).alias("kb"))
    mutual = (
        cell.join(side[a].withColumnRenamed("m", "ma"), [*keys, a])
        .join(side[b].withColumnRenamed("m", "mb"), [*keys, b])
        .groupBy(*keys)
        .agg(F.sum(F.col("o") * (F.log("o") - F.log("ma") - F.log("mb"))).alias("lab"))
    )
    if keys:
        one = total.join(pa, list(keys)).join(pb, list(keys)).join(mutual, list(keys))
    else:
        one = total
        for part in (pa, pb, mutual):
            one = one.withColumn("_p", one_value(part)).select("*", "_p.*").drop("_p")
    n = F.col("n")
    expected = F.col("pa") * F.col("pb") / pairs(n)
    middle = (F.col("pa") + F.col("pb")) / 2
    same = (F.col("ka") == 1) & (F.col("kb") == 1)
    mi = F.col("lab") / n + F.log(n)
    h = ((F.log(n) - F.col("la") / n) + (F.log(n) - F.col("lb") / n)) / 2
    return one.select(
        *keys,
        F.when(same | (middle == expected), 1.0).otherwise((F.col("pij") - expected) / (middle - expected)).alias("ari"),
        F.when(same, 1.0).when(h > 0, F.greatest(mi, F.lit(0.0)) / h).otherwise(0.0).alias("nmi"),
    )


def majority_label(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Most frequent label per cluster, ties to the first by name."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(cluster).agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col(label))).alias("_b"), F.sum("n").alias("total")
    ).select(cluster, F.col("_b")[label].alias("majority"), (-F.col("_b.m")).alias("n"), "total")


def cluster_profile(df: DataFrame, cols: Sequence[str], cluster: str, n: int = 8) -> DataFrame:
    """Per cluster the features whose mean lies furthest from the overall mean."""
    overall = per_column(df, cols, {"overall": F.avg})
    per = per_column(df, cols, {"mean": F.avg}, [cluster])
    gap = per.join(overall, "feature").withColumn("gap", F.abs(F.col("mean") - F.col("overall")))
    line = Window.partitionBy(cluster).orderBy(F.desc("gap"), "feature")
    return gap.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= n).select(
        cluster, "rank", "feature", "mean", "gap"
    )


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cluster_quality(
    df: DataFrame, vec: str, cluster: str, row_id: str, sample_size: int = 2000, seed: int = 42
) -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz and (on a sample) the Euclidean silhouette.

    ``vec`` is an array of doubles; noise (-1) is left out. Null with fewer than two clusters.
    """
    data = df.filter(F.col(cluster) != -1).select(row_id, cluster, F.col(vec).cast("array<double>").alias("x"))
    as_vector = array_to_vector("x")
    centres = data.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(as_vector)).alias("c"), F.count(F.lit(1)).alias("n")
    )
    middle = data.agg(vector_to_array(Summarizer.mean(as_vector)).alias("g"), F.count(F.lit(1)).alias("total"))
    d2 = _distance2(F.col("x"), F.col("c"))
    spread = (
        data.join(centres, cluster)
        .withColumn("d2", d2)
        .groupBy(cluster)
        .agg(F.first("c").alias("c"), F.first("n").alias("n"), F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"))
    )
    packed = spread.agg(F.collect_list(F.struct(cluster, "c", "n", "w", "s")).alias("k")).withColumn(
        "m", one_value(middle)
    )
    k = F.size("k").cast("double")
    within = F.aggregate("k", F.lit(0.0), lambda a, r: a + r["w"])
    between = F.aggregate("k", F.lit(0.0), lambda a, r: a + r["n"] * _distance2(r["c"], F.col("m.g")))

    def worst(r: Column) -> Column:
        others = F.filter("k", lambda o: o[cluster] != r[cluster])
        return F.array_max(F.transform(others, lambda o: (r["s"] + o["s"]) / F.sqrt(_distance2(r["c"], o["c"]))))

    db = F.aggregate(F.transform("k", worst), F.lit(0.0), lambda a, v: a + v) / k
    ch = (between / (k - 1)) / (within / (F.col("m.total") - k))
    sample = fixed_size(data, [row_id], sample_size, seed)
    return packed.select(
        F.size("k").alias("n_clusters"),
        F.when(F.size("k") >= 2, db).alias("davies_bouldin"),
        F.when(F.size("k") >= 2, ch).alias("calinski_harabasz"),
        one_value(silhouette(sample, "x", cluster).agg(F.avg("silhouette").alias("v")))["v"].alias("silhouette"),
    ).withColumn("weak", F.col("silhouette") < 0.20)


def silhouette(sample: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Euclidean silhouette of each row of a bounded sample."""
    sample = stage(sample, "silhouette")
    counts = sample.groupBy(cluster).count().orderBy(cluster).collect()  # a row per cluster
    names, sizes = np.array([r[0] for r in counts]), np.array([r[1] for r in counts])

    def add(d: np.ndarray, state: list, own: np.ndarray) -> list:
        codes = np.searchsorted(names, own)
        sums = [np.bincount(codes, weights=row, minlength=len(names)) for row in d]
        return [new + np.asarray(old) if len(old) else new for new, old in zip(sums, state)]

    summed = _fold(sample.select(vec, cluster), vec, sample, cluster, "sums", add)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, sums in zip(pdf[cluster], pdf["sums"]):
                at = int(np.searchsorted(names, own))
                if sizes[at] < 2 or len(sizes) < 2:
                    out.append(0.0)
                    continue
                a = sums[at] / (sizes[at] - 1)
                b = min(s / n for i, (s, n) in enumerate(zip(sums, sizes)) if i != at)
                out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            yield pd.DataFrame({cluster: pdf[cluster], "silhouette": out})

    kind = sample.schema[cluster].dataType.simpleString()
    return summed.mapInPandas(score, f"`{cluster}` {kind}, silhouette double")
