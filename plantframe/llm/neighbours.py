"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Each table hashes unit vectors by several Gaussian projections, cut into slots. If a query's projection is x, that of
a unit vector at cosine c is normal with mean c x and variance 1 - c^2, which gives every bucket its chance to hold it. The buckets of a
table are visited in the order of that chance until the visited ones together reach a target. All vectors met in any
table are compared exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantframe.session import stage


@dataclass(frozen=True)
class Hashing:
    """Settings of the index. Vectors at ``cosine`` or more are met with a probability of about
    ``1 - (1 - success) ** tables`` or more."""

    tables: int = 2
    functions: int = 8
    slots: int = 3
    width: float = 1.6
    cosine: float = 0.3
    success: float = 0.76
    seed: int = 7
    #: Vectors and queries that a task compares at once.
    block_vectors: int = 4096
    block_queries: int = 2048
    #: Queries whose buckets a task orders.
    probed_queries: int = 256

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (tables, dim, functions) and offsets (tables, functions)."""
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.tables, dim, self.functions)), rng.uniform(0, self.width, (self.tables, self.functions))

    def projected(self, unit: np.ndarray) -> np.ndarray:
        """Projections in units of slots, the lowest slot from 0: (tables, rows, functions)."""
        directions, offsets = self.projections(unit.shape[1])
        return (np.einsum("nd,tdf->tnf", unit, directions, optimize=True) + offsets[:, None]) / self.width + self.slots // 2

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table: (tables, rows)."""
        slot = np.clip(np.floor(self.projected(unit)), 0, self.slots - 1).astype(np.int64)
        return slot @ self.slots ** np.arange(self.functions)

    def probes(self, unit: np.ndarray) -> list[list[np.ndarray]]:
        """Per table and query the buckets to visit, the likeliest first."""
        edges = np.concatenate([[-np.inf], np.arange(1, self.slots), [np.inf]])
        normal = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
        out = []
        offsets = self.projections(unit.shape[1])[1] / self.width
        for table, offset in zip(self.projected(unit), offsets):
            of_table = []
            middle = (table - offset - self.slots // 2) * self.cosine + offset + self.slots // 2
            below = normal((edges - middle[:, :, None]) * self.width / math.sqrt(1 - self.cosine**2))
            chance = np.diff(below, axis=2)
            for one in chance:
                whole = np.ones(1)
                for slots in one:
                    whole = np.multiply.outer(slots, whole).ravel()
                order = np.argsort(-whole, kind="stable")
                n = int(np.searchsorted(np.cumsum(whole[order]), self.success)) + 1
                of_table.append(order[:n])
            out.append(of_table)
        return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of the vectors that take part: with an id, of the commonest length (of
    several, the smallest), all components finite and not all zero."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    size = rows.agg(F.mode(F.size("v"), True)).first()[0]
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("v") == F.lit(size)) & ~bad & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, the same for the same two vectors wherever they stand.

    Rows are scaled by powers of two, so that no square of a very large or small component is lost.
    """
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best(query_ids: np.ndarray, queries: np.ndarray, visits: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bucket: np.ndarray, k: int):
    """The ``k`` nearest visited ids of each query, each with its best score; ``visits[q, bucket[i]]`` says whether q
    visits vector i."""
    out = []
    if len(query_ids):
        by_id = np.argsort(ids, kind="stable")
        ids, vectors, bucket = ids[by_id], vectors[by_id], bucket[by_id]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        unit, step = _unit(vectors), 256
    for low in range(0, len(query_ids), step):
        part = slice(low, low + step)
        near = _unit(queries[part]) @ unit.T
        near[~visits[part][:, bucket] | (query_ids[part, None] == ids)] = -np.inf
        of_id = np.maximum.reduceat(near, first, axis=1)
        at = max(0, len(first) - k)
        # rounding of the product can't reorder what the exact comparison sees: ties at the border all pass
        border = np.partition(of_id, at, axis=1)[:, at] - 1e-9
        q, i = np.nonzero((near >= border[:, None]) & (near > -np.inf))
        score = cosines(queries[part][q], vectors[i])
        order = np.lexsort((-score, ids[i], q))
        again = (q[order][1:] == q[order][:-1]) & (ids[i[order]][1:] == ids[i[order]][:-1])
        once = order[np.append(True, ~again)[: len(order)]]
        q, i, score = q[once], i[once], score[once]
        order = np.lexsort((ids[i], -score, q))
        q, i, score = q[order], i[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        out.append((query_ids[part][q[keep]], ids[i[keep]], score[keep]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, hashing: Hashing = Hashing(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest vectors found for each query.

    Ties go to the smaller id. A query's own id is no candidate, and rows that share an id count once. Vectors that
    are null, zero, of an odd length or hold null or non-finite components take no part. No vectors or no queries give
    an empty result.

    Rows of a table meet in groups of buckets. A group with many vectors or queries is split into blocks, and every
    block of vectors meets every block of queries, so one task holds a block of each however common a vector is.
    """
    # copies of a row would fill the block of their id
    base = usable(vectors, id_column, vector_column).dropDuplicates(["id", "v"])
    asked = usable(queries, id_column, vector_column)
    total = base.count()
    groups = max(1, -(-total // hashing.block_vectors))

    def place(batches):
        for batch in batches:
            v = _matrix(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, 1))
            if not len(v):
                continue
            for table, bucket in enumerate(hashing.buckets(_unit(v))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), table, np.int32)), pa.array((bucket % groups).astype(np.int32)), pa.array(bucket.astype(np.int32)), batch.column(0), batch.column(1)],
                    ["table", "grp", "bucket", "id", "v"],
                )

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                for table, visits in enumerate(hashing.probes(_unit(_matrix(part.column(1), part.num_rows)))):
                    row, group, lists = [], [], []
                    for q, visit in enumerate(visits):
                        order = np.argsort(visit % groups, kind="stable")
                        of = (visit % groups)[order]
                        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        lists += np.split(visit[order].astype(np.int32), begin[1:])
                        row += [q] * len(begin)
                        group += of[begin].tolist()
                    rows = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), table, np.int32)), pa.array(group, pa.int32()), pa.array(lists, pa.list_(pa.int32())), rows.column(0), rows.column(1)],
                        ["table", "grp", "visits", "id", "v"],
                    )

    placed = base.mapInArrow(place, "table int, grp int, bucket int, id long, v array<double>")
    asked = asked.dropDuplicates(["id"])
    # ordering buckets is the costly part of a query: spread over tasks, and done once
    asked = asked.repartition(max(1, -(-asked.count() // hashing.probed_queries)), "id")
    asking = stage(asked.mapInArrow(ask, "table int, grp int, visits array<int>, id long, v array<double>"), "probes")
    # a row for each group of a table: tables x groups of block_vectors rows on average
    parts = stage(placed.groupBy("table", "grp").agg(F.ceil(F.count("*") / hashing.block_vectors).cast("int").alias("n_v")).join(
        asking.groupBy("table", "grp").agg(F.ceil(F.count("*") / hashing.block_queries).cast("int").alias("n_q")), ["table", "grp"]
    ), "parts")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, name: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(name)
    left = placed.join(parts, ["table", "grp"]).select("table", "grp", of("n_v", "bv"), blocks("n_q").alias("bq"), "bucket", "id", "v")
    right = asking.join(parts, ["table", "grp"]).select("table", "grp", blocks("n_v").alias("bv"), of("n_q", "bq"), "visits", "id", "v")
    keys = ["table", "grp", "bv", "bq"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = best(np.zeros(0, np.int64), None, None, None, np.ones((1, 1)), None, k)
        else:
            held, bucket = np.unique(a["bucket"].to_numpy(), return_inverse=True)
            visits = np.zeros((b.num_rows, len(held) + 1), bool)
            lists = b["visits"].combine_chunks()
            number = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(held, number), len(held) - 1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            visits[row, np.where(held[at] == number, at, len(held))] = True
            found = best(b["id"].to_numpy(), _matrix(b["v"], b.num_rows), visits, a["id"].to_numpy(), _matrix(a["v"], a.num_rows), bucket, k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
