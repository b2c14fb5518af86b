"""Whitening of vectors by an exact scatter matrix in residue numbers, and a symmetric eigendecomposition.

A component c becomes the integer x = floor(64 c) + 1,000,000. Each task multiplies its vectors' residues modulo a few
primes below 2^20 in double precision, 4,096 rows at a time, so that no sum passes 2^53 and every product is exact. A
column of ones beside the vectors gives their count and sums too. Residues are summed over tasks by Spark; the
Chinese remainder theorem makes of them the exact sums Q of x_i x_j and S of x_i, as there are
enough primes for the largest sum that n vectors of the largest |x| could have. Then the covariance of the
centred values is V = (n Q - S S^T) / n^2 without any rounding but the last, and its eigenvectors and -values come from numpy's eigh in doubles.

The driver holds d^2 numbers a prime for d components, whatever the number of vectors; a task holds one Arrow batch.

Defined results: a vector that is null or holds null or non-finite entries is dropped, as is one of another length
than the commonest (of equally common ones the longest): vectors of different lengths have no common covariance. Rows that
repeat count as often as they come. Ids may be null or repeated. Integers are cut at +-2^62, a deviation above 2^63 - 1 is null.
A component whose variance is zero (less than d x 2^-52 of the largest) can't be whitened: its whitened is
null, and it is left out of identity_error. explained is null where all vectors are equal. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Products of two residues below 2^20, summed over as many rows, stay below 2^52.
ROWS = 4096
TOP = 1 << 20
#: |x| is at most this; floats of a greater size are cut.
LIMIT = 1 << 62


def primes(product: int) -> list[int]:
    """The largest primes below TOP whose product is above the number given."""
    found, at, so_far = [], TOP - 1, 1
    while so_far <= product:
        if all(at % d for d in range(3, 1 + int(at**0.5), 2)):
            found.append(at)
            so_far *= at
        at -= 2
    return found


def rebuilt(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers, of either sign, that have these residues; of dtype object."""
    whole = 1
    for p in moduli:
        whole *= p
    out = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for r, p in zip(residues, moduli, strict=True)) % whole
    return np.where(out > whole // 2, out - whole, out)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * float(SCALE)), -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), dims)


def scatter(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Residues of [x, 1]^T [x, 1] modulo each prime, by exact products in doubles."""
    out = []
    for p in moduli:
        total = np.zeros((x.shape[1] + 1,) * 2, np.int64)
        for a in range(0, len(x), ROWS):
            r = np.ones((min(ROWS, len(x) - a), x.shape[1] + 1))
            r[:, :-1] = x[a : a + ROWS] % p
            total = (total + (r.T @ r).astype(np.int64) % p) % p
        out.append(total)
    return out


def _scattered(batches: Iterator[pa.RecordBatch], dims: int, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """One row for each prime and cell on or above the diagonal: what this task's vectors add to it."""
    total = None
    for batch in batches:
        part = scatter(integers(_vectors(batch.column(0), dims)), moduli)
        total = part if total is None else [(a + b) % p for a, b, p in zip(total, part, moduli, strict=True)]
    if total is not None:
        i, j = np.triu_indices(dims + 1)
        for p, m in zip(moduli, total, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(i * (dims + 1) + j), pa.array(m[i, j])], names=["prime", "cell", "residue"])


class Model(NamedTuple):
    """n vectors of S = sums; eigenvalues from the largest down, their unit eigenvectors as columns, and the trace of V."""

    dims: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.sums) * 2.0**-52 * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)


def _usable(vector: Column) -> Column:
    odd = lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("_id"), vector.alias("_vector")).where(_usable(F.col("_vector")))


def eigen(n: int, sums: list[int], products: np.ndarray) -> Model:
    """The model of exact sums: each entry of V is rounded once."""
    dims = len(sums)
    v = np.array([[(n * int(products[i, j]) - sums[i] * sums[j]) / n**2 for j in range(dims)] for i in range(dims)], float).reshape(dims, dims)
    values, vectors = np.linalg.eigh(v) if dims else (np.zeros(0), np.zeros((0, 0)))
    k = min(COMPONENTS, dims)
    return Model(dims, n, tuple(sums), values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy(), float(np.trace(v)))


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> Model:
    """Exact sums over all usable vectors, and their eigenvectors. The driver gets one row a length, then d^2 / 2 residues a prime."""
    ship(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    largest = F.greatest(F.abs(F.array_max("_vector")), F.abs(F.array_min("_vector")))
    lengths = rows.groupBy(F.size("_vector").alias("dims")).agg(F.count("*").alias("n"), F.max(largest).alias("top")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None or not lengths.dims:
        return Model(0, 0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    dims, n = lengths.dims, lengths.n
    top = int(min(lengths.top * SCALE, float(LIMIT))) + 1 + SHIFT
    moduli = primes(2 * n * top**2)
    parts = rows.where(F.size("_vector") == dims).select("_vector").mapInArrow(lambda it: _scattered(it, dims, moduli), "prime long, cell long, residue long")
    found = parts.groupBy("prime", "cell").agg((F.sum("residue") % F.col("prime")).alias("residue")).collect()
    at = {p: np.zeros((dims + 1) ** 2, np.int64) for p in moduli}
    for r in found:
        at[r.prime][r.cell] = r.residue
    exact = rebuilt([at[p] for p in moduli], moduli).reshape(dims + 1, dims + 1)
    upper = np.triu_indices(dims + 1)
    exact.T[upper] = exact[upper]
    assert exact[dims, dims] == n, "the vectors changed between two readings"
    return eigen(n, [int(s) for s in exact[:dims, dims]], exact[:dims, :dims])


def deviations(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int | None]]:
    """n x - S in doubles, each rounded once, and the exact sums of their squares."""
    top = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
    if model.dims * top**2 < 1 << 63:
        exact = x * model.n - np.array(model.sums, np.int64)
        return exact.astype(np.float64), (exact**2).sum(axis=1).tolist()
    exact = x.astype(object) * model.n - np.array(model.sums, object)
    return exact.astype(np.float64), [d if d < 1 << 63 else None for d in (exact**2).sum(axis=1)]


def whitened(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int | None]]:
    """The components of unit variance, NaN where there is none, and the deviations of integer vectors."""
    centred, squares = deviations(x, model)
    spread = np.sqrt(np.where(model.usable, model.values, np.nan))
    return (centred / model.n) @ model.vectors / spread, squares


def _products(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """What this task's whitened vectors, centred by the exact mean, add to sums and products."""
    total, k = 0.0, int(model.usable.sum())
    for batch in batches:
        x = integers(_vectors(batch.column(0), model.dims))
        for a in range(0, len(x), ROWS):
            w = np.ones((min(ROWS, len(x) - a), k + 1))
            w[:, :-1] = whitened(x[a : a + ROWS], model)[0][:, model.usable]
            total = total + w.T @ w
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2)), pa.array(total.ravel())], names=["cell", "total"])


def identity_error(vectors: DataFrame, model: Model, *, id_col: str = "vec_id", vector_col: str = "embedding") -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, by a pass over all of them."""
    k = int(model.usable.sum())
    if not k:
        return None
    rows = _rows(vectors, id_col, vector_col).where(F.size("_vector") == model.dims).select("_vector")
    sums = rows.mapInArrow(lambda it: _products(it, model), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    at = np.zeros((k + 1) ** 2)
    at[[r.cell for r in sums]] = [r.total for r in sums]
    at = at.reshape(k + 1, k + 1) / model.n
    return float(np.abs(at[:k, :k] - np.outer(at[:k, k], at[:k, k]) - np.eye(k)).max())


def _rows_out(batches: Iterator[pa.RecordBatch], model: Model, error: float | None) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            m = len(part)
            w, squares = whitened(integers(_vectors(part.column(1), model.dims)), model)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, m), from_pandas=True),
                    pc.fill_null(pa.nulls(m * k, pa.float64()), error) if error is not None else pa.nulls(m * k, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, model: Model, error: float | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    ship(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col).where(F.size("_vector") == model.dims)
    schema = f"vec_id {rows.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(lambda it: _rows_out(it, model, error), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of embeddings, whitened: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    return whiten(vectors, model, identity_error(vectors, model))
