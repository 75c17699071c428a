"""Hard negatives of anchors by a multiway hyperplane tree with distance ranges between siblings.

Scores are integer inner products. With one more component that gives all rows the same norm, a score is a distance:
|q - x|^2 = |q|^2 + M^2 - 2 score, so a window of scores is an annulus around the anchor. A node of the tree has several
split points; each row belongs to the nearest one, and for each pair of a split point and a sibling's subtree the node
keeps the range of their distances. An anchor's distance to a split point, plus or minus its annulus, must meet these
ranges, or the sibling is out. What is left, are leaves, and those are compared exactly.

Split points come from a bounded sample; every row is routed, and the ranges are those of all rows. Pruning is exact:
the tree decides only how much is compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantframe.session import stage

_WINDOWS = "array<struct<w:int,lo:long,hi:long>>"


@dataclass(frozen=True)
class Shape:
    """Bounds of the tree and of what a task compares at once."""

    #: distinct vectors that split points are chosen from; the size of the tree is bounded by it
    sample: int = 8192
    branches: int = 16
    #: nodes expected to hold at most so many rows are leaves
    leaf_rows: int = 2048
    block_rows: int = 8192
    block_queries: int = 256


def integers(vectors: DataFrame, id_column: str, label_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``x`` (floor of the scaled components) and a hash ``h`` of label and ``x``, each row once.

    Rows with a null id, label, vector or component, a non-finite component, no components or another than the
    commonest number of them (of several, the smallest) take no part, nor do those with components so large that a
    hundredfold inner product could pass the range of long. Rows that are equal in id, label and ``x`` are one.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda c: c * F.lit(float(scale)))
    most = F.sqrt(F.lit(2.0**56) / F.size("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= most))
    sound = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select("id", "label", scaled.alias("c")).filter(~bad)
    size = sound.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), "size").first()
    whole = sound.filter(F.size("c") == F.lit(size[0] if size else 0)).select("id", "label", F.transform("c", lambda c: F.floor(c).cast("long")).alias("x"))
    return whole.distinct().select("*", F.xxhash64("label", "x").alias("h"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


@dataclass
class Tree:
    """Nodes with split points (already with the additional component) and distance ranges, flat.

    ``children[n][j]`` is a node, or a leaf l as -1 - l. ``low[n][i, j]`` and ``high[n][i, j]`` are the least and the
    largest distance between split point i and the rows of child j.
    """

    norm: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm - (x * x).sum(axis=1), 0))])

    def distances(self, rows: np.ndarray, node: int) -> np.ndarray:
        points = self.points[node]
        square = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * rows @ points.T
        return np.sqrt(np.maximum(square, 0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * np.sqrt(self.norm) + 1e-9

    def grow(self, rows: np.ndarray, share: float, shape: Shape) -> int:
        """A node or leaf for sample rows that stand for ``share`` table rows each."""
        if len(rows) * share <= shape.leaf_rows or len(rows) < 4 * shape.branches:
            self.leaves += 1
            return -self.leaves
        # points far from each other: each is the farthest from those before it, from the middle of the rows outwards
        chosen = [int(np.argmin(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))]
        nearest = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < shape.branches and nearest.max() > 0:
            chosen.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        node = len(self.points)
        self.points.append(rows[chosen])
        self.children.append([])
        part = self.distances(rows, node).argmin(axis=1)
        if len(chosen) == 1:
            self.points.pop(), self.children.pop()
            self.leaves += 1
            return -self.leaves
        found = [self.grow(rows[part == j], share, shape) for j in range(len(chosen))]
        self.children[node] = found
        return node

    def route(self, x: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of each row; ``seen(node, child, distances)`` gets the distances of the rows of each child."""
        rows, leaf = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, at = todo.pop()
            far = self.distances(rows[at], node)
            part = far.argmin(axis=1)
            for j in np.unique(part):
                mine = part == j
                if seen is not None:
                    seen(node, int(j), far[mine])
                child = self.children[node][j]
                if child < 0:
                    leaf[at[mine]] = -1 - child
                else:
                    todo.append((child, at[mine]))
        return leaf

    def annuli(self, x: np.ndarray, query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer radius of each window of scores around its query."""
        whole = (x.astype(np.float64) ** 2).sum(axis=1)[query] + self.norm
        inner = np.sqrt(np.maximum(whole - 2 * hi.astype(np.float64), 0))
        outer = np.sqrt(np.maximum(whole - 2 * lo.astype(np.float64), 0))
        return inner, outer

    def visits(self, x: np.ndarray, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Windows and leaves whose ranges meet; with ``nearest`` one leaf for each window, that of the least bound.

        A window belongs to row ``query`` of ``x`` and holds scores from ``lo`` to ``hi``.
        """
        if not self.points:
            return np.arange(len(query)), np.zeros(len(query), np.int64)
        rows = np.column_stack([x.astype(np.float64), np.zeros(len(x))])
        inner, outer = self.annuli(x, query, lo, hi)
        windows, leaves, bounds = [], [], []
        todo = [(0, np.arange(len(query)), np.zeros(len(query)))]
        while todo:
            node, at, least = todo.pop()
            asked, back = np.unique(query[at], return_inverse=True)
            far = self.distances(rows[asked], node)[back]
            for j, child in enumerate(self.children[node]):
                low, high = self.low[node][:, j], self.high[node][:, j]
                if low[0] > high[0]:
                    continue  # no rows there
                under = np.maximum(np.maximum(low - far, far - high).max(axis=1), least)
                over = (far + high).min(axis=1)
                open_ = (under <= outer[at] + self.slack) & (over >= inner[at] - self.slack)
                if child < 0:
                    windows.append(at[open_])
                    leaves.append(np.full(int(open_.sum()), -1 - child))
                    bounds.append(np.maximum(under, inner[at])[open_])
                elif open_.any():
                    todo.append((child, at[open_], under[open_]))
        window, leaf, bound = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (windows, leaves, bounds))
        if nearest:
            order = np.lexsort((leaf, bound, window))
            first = order[np.append(True, window[order][1:] != window[order][:-1])[: len(order)]]
            return window[first], leaf[first]
        return window, leaf


def build(rows: DataFrame, shape: Shape = Shape()) -> Tree:
    """Tree over staged rows of ``integers``: split points of a sample, ranges of all rows."""
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)
    norm, total = rows.agg(F.max(square), F.count("*")).first()
    tree = Tree(float(norm or 0))
    sample = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(shape.sample)
    drawn = np.array([r.x for r in sample.collect()], np.int64)
    if not len(drawn):
        return tree
    tree.grow(tree.lifted(drawn), total / len(drawn), shape)

    def ranges(batches):
        least: dict[tuple[int, int], np.ndarray] = {}
        most: dict[tuple[int, int], np.ndarray] = {}

        def seen(node, child, far):
            key = node, child
            least[key] = np.minimum(far.min(axis=0), least.get(key, np.inf))
            most[key] = np.maximum(far.max(axis=0), most.get(key, -np.inf))

        for batch in batches:
            if batch.num_rows:
                tree.route(_matrix(batch.column(0)), seen)
        out = [(n, c, i, lo, hi) for n, c in least for i, (lo, hi) in enumerate(zip(least[n, c].tolist(), most[n, c].tolist()))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["node", "child", "point", "lo", "hi"])

    for points in tree.points:
        tree.low.append(np.full((len(points), len(points)), np.inf))
        tree.high.append(np.full((len(points), len(points)), -np.inf))
    found = rows.select("x").mapInArrow(ranges, "node int, child int, point int, lo double, hi double")
    for r in found.groupBy("node", "child", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        tree.low[r.node][r.point, r.child], tree.high[r.node][r.point, r.child] = r.lo, r.hi
    return tree


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Rows with their ``leaf``."""

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.route(_matrix(batch.column(2)))), *batch.columns], ["leaf", "id", "label", "x", "h"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "x", "h").mapInArrow(route, f"leaf long, id long, label {label}, x array<long>, h long")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= border)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _scan(leaves: DataFrame, asked: DataFrame, tree: Tree, k: int, same: bool, nearest: bool, shape: Shape) -> DataFrame:
    """The ``k`` best rows of each window in the leaves it visits: ``q``, ``qh``, ``w``, ``id``, ``h``, ``score``, ``rank``.

    A leaf with many rows or queries is split into blocks, and each block of rows meets each block of queries.
    """
    label = asked.schema["label"].dataType.simpleString()

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(4)
                flat = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                w, lo, hi = (flat.field(i).to_numpy() for i in range(3))
                window, leaf = tree.visits(_matrix(part.column(3)), of, lo, hi, nearest)
                if not len(window):
                    continue
                order = np.lexsort((window, leaf, of[window]))
                window, leaf = window[order], leaf[order]
                first = np.flatnonzero(np.append(True, (of[window][1:] != of[window][:-1]) | (leaf[1:] != leaf[:-1])))
                values = pa.StructArray.from_arrays([pa.array(v[window]) for v in (w, lo, hi)], ["w", "lo", "hi"])
                wins = pa.ListArray.from_arrays(pa.array(np.append(first, len(window)).astype(np.int32)), values)
                take = part.take(pa.array(of[window[first]]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[first].astype(np.int64)), *[take.column(i) for i in range(4)], wins], ["leaf", "q", "qh", "label", "x", "wins"])

    visits = asked.select("q", "qh", "label", "x", "wins").mapInArrow(visit, f"leaf long, q long, qh long, label {label}, x array<long>, wins {_WINDOWS}")
    visits = stage(visits, "visits")
    blocks = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / shape.block_rows).cast("int").alias("n_r"))
    blocks = stage(blocks.join(visits.groupBy("leaf").agg(F.ceil(F.count("*") / shape.block_queries).cast("int").alias("n_q")), "leaf"), "blocks")
    dealt = lambda n, name, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    keys = ["leaf", "br", "bq"]
    left = leaves.join(blocks, "leaf").select("leaf", dealt("n_r", "br", "id", "h"), every("n_q", "bq"), "id", "label", "x", "h")
    right = visits.join(blocks, "leaf").select("leaf", every("n_r", "br"), dealt("n_q", "bq", "q", "qh"), "q", "qh", "label", "x", "wins")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, h, x = a["id"].to_numpy(), a["h"].to_numpy(), _matrix(a["x"])
            scores = products(_matrix(b["x"]), x)
            labels = {v: i for i, v in enumerate(dict.fromkeys(a["label"].to_pylist()))}
            own = np.array([labels[v] for v in a["label"].to_pylist()])
            for row, (q, qh, mark, wins) in enumerate(zip(*(b[c].to_pylist() for c in ("q", "qh", "label", "wins")))):
                alike = own == labels.get(mark, -1)
                fit = np.flatnonzero((alike if same else ~alike) & ~((ids == q) & (h == qh)))
                s, i = scores[row][fit], ids[fit]
                for win in wins:
                    inside = np.flatnonzero((s >= win["lo"]) & (s <= win["hi"]))
                    best = inside[_best(s[inside], i[inside], k)]
                    out += [(q, qh, win["w"], int(i[p]), int(h[fit[p]]), int(s[p])) for p in best]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate(zip(("q", "qh", "w", "id", "h", "score"), types))})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "q long, qh long, w int, id long, h long, score long")
    order = Window.partitionBy("q", "qh", "w").orderBy(F.desc("score"), "id", "h")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(leaves: DataFrame, queries: DataFrame, tree: Tree, k: int, same: bool, shape: Shape = Shape()) -> DataFrame:
    """The ``k`` highest scores of each window among rows of the query's label, or of others.

    ``queries`` has ``q``, ``qh``, ``label``, ``x`` and ``wins``. Each window first sees its most promising leaf; the
    score found there at rank k narrows its annulus, and all leaves that still meet it are compared.
    """
    first = _scan(leaves, queries, tree, k, same, True, shape)
    reached = first.filter(F.col("rank") == k).select("q", "qh", "w", "score")
    wins = queries.select("q", "qh", F.explode("wins").alias("win")).select("q", "qh", "win.*").join(reached, ["q", "qh", "w"], "left")
    narrow = wins.groupBy("q", "qh").agg(F.collect_list(F.struct("w", F.greatest("lo", F.coalesce("score", "lo")).alias("lo"), "hi")).alias("wins"))
    again = stage(queries.drop("wins").join(narrow, ["q", "qh"]).select("q", "qh", "label", "x", "wins"), "narrowed")
    return _scan(leaves, again, tree, k, same, False, shape)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, shape: Shape = Shape(),
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    Positives are the anchor's ``positives`` highest other rows of its label, negatives the ``negatives`` highest rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score; ties go to smaller ids.
    ``anchors`` are rows of ``vectors``; which rows take part, says ``integers``. Rows that share an id but differ are
    rows of their own. Fewer rows than asked for give all there are, none give none; empty tables an empty result.
    """
    rows = stage(integers(vectors, id_column, label_column, vector_column, scale), "vectors")
    asked = integers(anchors, id_column, label_column, vector_column, scale)
    tree = build(rows, shape)
    leaves = stage(placed(rows, tree), "leaves")
    every = F.array(F.struct(F.lit(0).alias("w"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi")))
    queries = stage(asked.select(F.col("id").alias("q"), F.col("h").alias("qh"), "label", "x", every.alias("wins")), "anchors")
    near = stage(search(leaves, queries, tree, positives, True, shape).select("q", "qh", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lo = F.expr(f"-((-positive_score * {low}L - pmod(-positive_score * {low}L, 100L)) DIV 100L)")
    hi = F.expr(f"(positive_score * {high}L - pmod(positive_score * {high}L, 100L)) DIV 100L")
    windows = near.select("q", "qh", F.struct("w", lo.alias("lo"), hi.alias("hi")).alias("win")).filter("win.lo <= win.hi")
    windows = windows.groupBy("q", "qh").agg(F.collect_list("win").alias("wins"))
    second = stage(queries.drop("wins").join(windows, ["q", "qh"]).select("q", "qh", "label", "x", "wins"), "windows")
    found = search(leaves, second, tree, negatives, False, shape)
    return found.select("q", "qh", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["q", "qh", "w"]).select(
        F.col("q").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
