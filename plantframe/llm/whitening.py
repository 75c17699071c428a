"""Whitening of embeddings by shifted CholeskyQR.

The centred rows are orthogonalised by distributed passes: each pass sums a Gram matrix, its Cholesky factor R is
composed with those before it, and the next pass solves the rows against what is composed so far. The first factor is
shifted, so that it exists however badly the rows are conditioned. The singular values of the composed R are those of
the rows, without ever squaring their condition; its right singular vectors are the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantframe.session import stage

#: Gram passes after the shifted one at most; two suffice unless the rows are nearly dependent.
PASSES = 4
#: Rows that are centred and multiplied at once.
BLOCK = 8192


def integers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``x`` (array of long, floor of the scaled components) of the vectors that take part.

    Those are not null, not empty, of the commonest length (of several, the shortest), and hold neither null nor
    non-finite components, nor any whose scaled value is 2^62 or more. Rows may repeat, ids may be null or repeat.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda c: c * F.lit(float(scale)))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 62)))
    sound = rows.filter("v IS NOT NULL AND size(v) > 0").select("id", scaled.alias("c")).filter(~bad)
    sizes = sound.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), "size").first()
    x = F.transform("c", lambda c: F.floor(c).cast("long"))
    return sound.filter(F.size("c") == F.lit(sizes[0] if sizes else 0)).select("id", x.alias("x"))


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums of their components; rows are centred without rounding their integer part."""

    n: int
    sums: tuple[int, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 over the components, exactly."""
        most = max([self.n * int(np.abs(x).max(initial=0)) + abs(s) for s in self.sums], default=0)
        if len(self.sums) * most * most < 1 << 63:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        return [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]


@dataclass(frozen=True)
class Whitening:
    """Centre, components (columns of ``components``), their variances, and the variance of all dimensions."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    total: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components and scaled to unit variance; NaN on components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.centre.of(x) @ self.components / np.sqrt(self.variances), np.nan)


def _sum_of_rows(fit: DataFrame) -> Centre | None:
    def part(batches):
        sums, n = None, 0
        for batch in batches:
            if batch.num_rows:
                # halves of 32 bits, so that sums of a batch can't overflow
                x = _rows(batch, 0)
                both = [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
                sums = both if sums is None else [a + b for a, b in zip(sums, both)]
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([str(s) for s in sums]), pa.array([n] * len(sums), pa.int64())], ["i", "s", "n"])

    parts = fit.select("x").mapInArrow(part, "i int, s string, n long")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return Centre(int(rows[0].n), tuple(int(r.s) for r in rows)) if rows else None


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q of ``Q factor = rows`` for an upper triangular factor, column by column."""
    q = np.empty_like(rows)
    for j in range(len(factor)):
        q[:, j] = (rows[:, j] - q[:, :j] @ factor[:j, j]) / factor[j, j]
    return q


def _gram(fit: DataFrame, centre: Centre, factor: np.ndarray | None = None, onto: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows, solved against a triangular factor or projected onto columns.

    Tasks sum their rows, then each row of the matrix is summed by itself; the driver sees one matrix of dimensions by
    dimensions.
    """

    def part(batches):
        total = None
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                block = batch.slice(low, BLOCK)
                q = centre.of(_rows(block, 0))
                q = q if factor is None else _solved(q, factor)
                q = q if onto is None else q @ onto
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    def added(table: pa.Table) -> pa.Table:
        rows = table["g"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        # in the order of their values, whatever order they come in
        return pa.table({"i": table["i"].slice(0, 1), "g": pa.array([np.sort(rows, axis=0).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(part, "i int, g array<double>")
    rows = parts.groupBy("i").applyInArrow(added, "i int, g array<double>").orderBy("i").collect()
    total = np.array([r.g for r in rows])
    return (total + total.T) / 2


def orthogonal_factor(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows: their Gram matrix is that of R, and its singular values are as exact as theirs."""
    gram = _gram(fit, centre)
    d = len(gram)
    eps = np.finfo(np.float64).eps / 2
    # the norm is bounded by the trace; dimensions without variance need a shift above zero
    shift = 11 * (centre.n * d + d * (d + 1)) * eps * np.trace(gram)
    factor = np.linalg.cholesky(gram + max(shift, np.finfo(np.float64).tiny) * np.eye(d)).T
    for _ in range(PASSES):
        gram = _gram(fit, centre, factor)
        if np.abs(gram - np.eye(d)).max() < 64 * d * eps:
            break
        values = np.linalg.eigvalsh(gram)
        if values[0] <= 16 * d * eps * values[-1]:
            # the rows span less than all dimensions: no Cholesky factor, but a root, ends the composition
            values, vectors = np.linalg.eigh(gram)
            return (np.sqrt(np.where(values > 16 * d * eps * values[-1], values, 0.0)) * vectors).T @ factor
        factor = np.linalg.cholesky(gram).T @ factor
    return factor


def fit(distinct: DataFrame, k: int) -> Whitening | None:
    """Whitening of a table of distinct ``x`` onto the ``k`` components of the largest variance; none without rows.

    Components of equal variance may be turned among themselves. The sign makes the entry of the largest size positive.
    """
    centre = _sum_of_rows(distinct)
    if centre is None:
        return None
    factor = orthogonal_factor(distinct, centre)
    _, singular, right = np.linalg.svd(factor)
    variances = singular**2 / centre.n
    variances = np.where(singular > len(singular) * np.finfo(np.float64).eps * singular[0], variances, 0.0)
    components = right[:k].T
    largest = np.take_along_axis(components, np.abs(components).argmax(axis=0)[None], axis=0)
    return Whitening(centre, components * np.where(largest < 0, -1.0, 1.0), variances[:k], float(variances.sum()))


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over it; none without
    a component that has variance."""
    live = model.variances > 0
    if not live.any():
        return None
    scaled = model.components[:, live] / np.sqrt(model.variances[live])
    gram = _gram(distinct, model.centre, onto=scaled)
    return float(np.abs(gram / model.centre.n - np.eye(len(gram))).max())


def whiten(vectors: DataFrame, k: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """One row for each row that takes part (see ``integers``) and component up to ``k``, or up to the dimensions if fewer.

    Columns: the id, ``component`` (from 1, by falling variance), ``n`` (distinct vectors), ``deviation`` (sum of
    (n x - S)^2, decimal, exact), ``whitened`` (null for a component without variance), ``explained`` (share of the
    variance; null if there is none), ``identity_error``. Equal vectors count once in the fit and keep their rows in
    the result. An empty table gives an empty result.
    """
    rows = stage(integers(vectors, id_column, vector_column, scale), "integers")
    distinct = stage(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, k)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, deviation string, whitened double, explained double"
    error = None if model is None else identity_error(distinct, model)

    def project(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                block = batch.slice(low, BLOCK)
                x = _rows(block, 1)
                out = model.whitened(x)
                m = out.shape[1]
                at = np.repeat(np.arange(len(x)), m)
                deviation = [str(v) for v in model.centre.deviation(x)]
                explained = model.variances / model.total if model.total else np.full(m, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(deviation).take(pa.array(at)),
                        pa.array(out.ravel(), from_pandas=True), pa.array(np.tile(explained, len(x)), from_pandas=True),
                    ],
                    ["id", "component", "deviation", "whitened", "explained"],
                )

    projected = rows.mapInArrow(project, schema) if model is not None else rows.sparkSession.createDataFrame([], schema)
    return projected.select(
        F.col("id").alias(id_column), "component", F.lit(model.centre.n if model else None).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(error).cast("double").alias("identity_error"),
    )
