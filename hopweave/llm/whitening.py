"""Whitening of embeddings by matrix-free block Lanczos.

The covariance V of the fit list is never formed. Spark multiplies: each pass has every task add up x'(xv) of its centred rows
for a block v of directions, and Spark sums the d x block results by row of the matrix, so no task or driver sees more than
d x block numbers of each task. On the driver a basis of directions grows by such blocks, each new one orthogonalised twice
against all before (full reorthogonalisation). Ritz pairs of the basis are taken from the products already at hand, and so are
their residuals; iteration ends when the wanted ones are within `tol` of the largest eigenvalue, or when the basis is the whole
space. A block that has lost rank (a breakdown: the space so far is invariant) goes on with new random directions, and a basis
that outgrows `most_basis` restarts from its best Ritz vectors.

Entries become integers x = floor(64 c) + 1000000, so counts, sums and deviations sum((n x - S)^2) are exact; rows are centred as
(n x - S) / n before any product. The trace of V is the sum of all deviations over n^3, so explained shares need no spectrum.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty ones and those of another
length than most remaining rows have (of equally frequent lengths the longest holds); rows that repeat count each; null vec_ids
are ids; entries beyond +-2^24 count as that; a deviation beyond a long is null; components whose eigenvalue is 0 to rounding
(fewer distinct directions than asked for, a single row) can't be scaled to variance 1 and are not returned; an empty table
gives no rows. Components are as wide as their embedding, so what reaches the driver is bounded by its length, not by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, unused

COMPONENTS, BLOCK, TOL = 32, 16, 1e-13
#: Directions kept at once; at 4096 numbers each these take 17 MB.
MOST_BASIS = 512
#: Passes after which a spectrum that has not converged is an error.
MOST_PASSES = 500
SHIFT, UNITS, LARGEST = 1_000_000, 64, float(1 << 24)
#: Eigenvalues below this share of the trace are 0 to rounding.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # d, exact
    values: np.ndarray  # k, falling
    vectors: np.ndarray  # d x k, unit columns
    trace: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def vectors_of(batch: pa.RecordBatch, column: str, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the valid rows (of length d) of a list column, and their entries as integers."""
    col = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == d)
    flat = pc.list_flatten(col.take(pa.array(places)))
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), d)  # null is NaN
    good = np.isfinite(c).all(axis=1)
    scaled = np.clip(np.floor(UNITS * c[good]), -LARGEST * UNITS, LARGEST * UNITS)
    return places[good], scaled.astype(np.int64) + SHIFT


def valid(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))))


def summed(df: DataFrame, column: str, d: int, width: int, of: Callable[[np.ndarray], np.ndarray], type_: str = "double") -> np.ndarray:
    """The sum over all rows of of(x), a matrix with `width` columns, of which each task adds up its own first."""
    arrow = pa.float64() if type_ == "double" else pa.int64()
    names = [f"c{i}" for i in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(vectors_of(batch, column, d)[1])
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(total[:, i], arrow) for i in range(width)]], names=["row", *names])

    schema = ", ".join(["row int", *[f"{c} {type_}" for c in names]])
    kind = "double" if type_ == "double" else "decimal(38,0)"
    rows = small_batches(df.select(column)).mapInArrow(task, schema).groupBy("row").agg(*[F.sum(F.col(c).cast(kind)).alias(c) for c in names]).collect()
    out = np.zeros((len(rows), width), object if type_ != "double" else float)
    for r in rows:
        out[r["row"]] = list(r)[1:]
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Unit directions orthogonal to the basis and to each other: block's, and random ones where block has lost rank."""
    d, room = block.shape[0], block.shape[0] - basis.shape[1]
    out = np.zeros((d, 0))
    for i in range(min(block.shape[1], room)):
        v, size = block[:, i], scale
        for _ in range(8):
            before = np.hstack([basis, out])
            w = v - before @ (before.T @ v)
            w -= before @ (before.T @ w)
            if np.linalg.norm(w) > 1e-10 * size:
                break
            v = rng.standard_normal(d)  # a breakdown: the space so far is invariant
            size = np.linalg.norm(v)
        w /= np.linalg.norm(w)
        w -= before @ (before.T @ w)
        out = np.hstack([out, (w / np.linalg.norm(w))[:, None]])
    return out


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tol: float = TOL, most_basis: int = MOST_BASIS, most_passes: int = MOST_PASSES, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, falling, with unit vectors, of the symmetric matrix that multiply applies to d x b blocks; passes."""
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new, passes = orthonormal(rng.standard_normal((d, min(block, d))), basis, rng, 1.0), 0
    most_basis = max(most_basis, k + 2 * block)
    while True:
        product = multiply(new)
        passes += 1
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        m = min(k, len(values))
        residual = image @ y[:, :m] - (basis @ y[:, :m]) * values[:m]
        if basis.shape[1] == d or (m == k and np.linalg.norm(residual, axis=0).max() <= tol * max(values[0], 0.0)):
            vectors = basis @ y[:, :m]
            return values[:m], vectors / np.linalg.norm(vectors, axis=0), passes
        if passes == most_passes:
            raise ArithmeticError(f"no convergence to {tol} in {passes} passes")
        new = orthonormal(product, basis, rng, max(float(np.linalg.norm(product, axis=0).max()), 1e-300))
        if basis.shape[1] + block > most_basis:  # restart from the best: the residuals of all of them lie in the new block
            best = y[:, : k + block]
            basis, image = basis @ best, image @ best


def fit(df: DataFrame, column: str, k: int = COMPONENTS, block: int = BLOCK, tol: float = TOL) -> Whitening | None:
    """The whitening of df's valid rows; None if there are none."""
    good = valid(df.select(column), column)
    lengths = good.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    sums = summed(df, column, d, 1, lambda x: x.sum(axis=0)[:, None], "long")[:, 0]
    sums = np.array([int(s) for s in sums], np.int64)

    def multiply(v: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ v)

        return summed(df, column, d, v.shape[1], of) / n

    trace = float(sum_of_deviations(df, column, d, n, sums) / Decimal(n) ** 3)
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    values, vectors, passes = block_lanczos(multiply, d, min(k, d), block, tol)
    real = values > NOTHING * trace
    values, vectors = values[real], vectors[:, real]
    turned = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)
    return Whitening(n, sums, values, vectors * np.where(turned < 0, -1.0, 1.0), trace, passes)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """sum((n x - S)^2) of each row, exact."""
    y = n * x - sums
    if len(y) == 0:
        return []
    if float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return (y.astype(object) ** 2).sum(axis=1).tolist()


def sum_of_deviations(df: DataFrame, column: str, d: int, n: int, sums: np.ndarray) -> Decimal:
    """Exact: each task's sum in two parts of 18 digits, which Spark adds up as decimals."""
    part = 10**18

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(deviations(vectors_of(b, column, d)[1], n, sums)) for b in batches)
        yield pa.record_batch([pa.array([total // part], pa.int64()), pa.array([total % part], pa.int64())], names=["high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    row = small_batches(df.select(column)).mapInArrow(task, "high long, low long").agg(whole("high"), whole("low")).first()
    return Decimal(row[0] or 0) * part + Decimal(row[1] or 0)


def project(x: np.ndarray, w: Whitening) -> np.ndarray:
    return centred(x, w.n, w.sums) @ (w.vectors / np.sqrt(w.values))


def identity_error(df: DataFrame, column: str, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(w.values)

    def of(x: np.ndarray) -> np.ndarray:
        z = project(x, w)
        return np.vstack([z.T @ z, z.sum(axis=0)[None]])

    total = summed(df, column, len(w.sums), k, of) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_column: str, column: str, k: int = COMPONENTS, block: int = BLOCK, tol: float = TOL) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each valid row of df and component."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(df, column, k, block, tol)
    if w is None or len(w.values) == 0:
        return df.sparkSession.createDataFrame([], schema)
    error, wide = identity_error(df, column, w), len(w.values)
    name = unused(df.select(id_column, column), "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = vectors_of(batch, column, len(w.sums))
            ids = batch.column(0).take(pa.array(np.repeat(places, wide)))
            dev = [v if v < 1 << 63 else None for v in deviations(x, w.n, w.sums)]
            rows = len(places)
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * wide, w.n, np.int64)),
                    pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(rows), wide))),
                    pa.array(project(x, w).reshape(-1)),
                    pa.array(np.tile(w.explained, rows)),
                    pa.array(np.full(rows * wide, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return small_batches(df.select(F.col(id_column).alias(name), column)).mapInArrow(task, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
