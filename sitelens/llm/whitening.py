"""Embedding whitening: principal components by matrix-free block Lanczos, and every vector projected on them with unit variance.

Entries c become integers x = floor(64 c) + 1,000,000, so n and the sums S of each dimension are exact, and so is a row's deviation, the sum over
dimensions of (n x - S)^2. The trace of the covariance V is the sum of all deviations / n^3; with it an eigenvalue's share is known without
the others.

V is never formed. A pass sends a block Q of a few columns to all tasks; each sums Xc'(Xc Q) over its rows, where Xc = x - S/n is taken from the integers
(a whole base per dimension is subtracted first, so nothing is lost to the offset), and gives one row for each dimension, which Spark adds up. On the driver
are only matrices of the dimension by the basis.

Block Lanczos: the next block is V's image of the last one, made orthogonal to the whole basis twice (full reorthogonalisation). Columns that vanish in
that (breakdown: the basis is invariant under V) are replaced by random ones orthogonal to the basis. Rayleigh-Ritz over the whole basis gives the eigenpairs, whose
residuals |V u - e u| come from the stored images. When those of all wanted pairs are within `TOLERANCE` of the largest eigenvalue, or rounding lets them fall no further, `CONFIRM` more steps from a random
block must leave them so, as a start may miss copies of a multiple eigenvalue. A basis of over `MAX_BASIS` columns is restarted from its best Ritz vectors; one that spans the
whole space ends the search.

Defined cases: rows whose vector is null or has a null or non-finite entry are dropped, and so are vectors of another length than most have (of equally
common lengths the longer counts) and empty ones; equal vectors count as often as they are there; null vec_ids are kept; components without variance (rounding
of the largest eigenvalue or less) are left out, so one vector or equal vectors give no rows; an empty table gives none; entries beyond 2^55 count as 2^55;
a deviation that no long holds is null, and the trace is then summed in floating point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, stored, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK = 8
TOLERANCE = 1e-13
CONFIRM = 2
MAX_BASIS = 512
SEED = 42
#: Entries of vectors that a worker turns into floats at once.
ENTRIES = 2_000_000
_EPS = np.finfo(np.float64).eps


def integers(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows that count, written to the shared folder."""
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    v = v.where("v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    most = float(1 << 55)
    x = stored(v.select("vec_id", F.expr(f"transform(v, c -> floor({SCALE} * least(greatest(c, -{most}D), {most}D)) + {OFFSET}L)").alias("x")), "integers")
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (common["d"] if common else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and the rows of x, as many at once as `ENTRIES` allows."""
    step = max(1, ENTRIES // d)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, d)


@dataclass(frozen=True)
class Fit:
    """The fit list's size, dimension, and exact sums."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        base = [s // self.n for s in self.sums]
        object.__setattr__(self, "base", np.array(base, np.int64))
        object.__setattr__(self, "over", np.array([s - self.n * m for s, m in zip(self.sums, base, strict=True)], np.int64))

    @property
    def d(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.over / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray | None:
        """Exact, or none where a long may not hold one."""
        apart = x - self.base
        largest = int(np.abs(apart).max(initial=0)) + 1
        if self.d * (self.n * largest) ** 2 >= 1 << 63:
            return None
        apart = self.n * apart - self.over
        return (apart * apart).sum(1)

    def long_deviations(self, x: np.ndarray) -> list[int | None]:
        exact = self.deviations(x)
        if exact is not None:
            return exact.tolist()
        values = (sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x)
        return [v if v < 1 << 63 else None for v in values]


def fit_list(x: DataFrame) -> Fit | None:
    first = x.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for _, rows in _blocks(batches, d):
            n += len(rows)
            whole = int(np.abs(rows).max()) * len(rows) < 1 << 62
            sums = [a + int(b) for a, b in zip(sums, rows.sum(0) if whole else rows.astype(object).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["dim", "n", "s"])

    rows = x.mapInArrow(apply, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return Fit(rows[0]["n"], [int(r["s"]) for r in rows])


def _added(x: DataFrame, d: int, rows: int, columns: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of x of a matrix of rows by columns; each task sends one, Spark adds them up by row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for _, block in _blocks(batches, d):
            total += of(block)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], ["row", *names])

    names = [f"y{k}" for k in range(columns)]
    parts = x.mapInArrow(apply, "row int, " + ", ".join(f"{k} double" for k in names))
    got = parts.groupBy("row").agg(*[F.sum(k).alias(k) for k in names]).orderBy("row").collect()
    return np.array([[r[k] for k in names] for r in got]) if got else np.zeros((rows, columns))


def trace(x: DataFrame, fit: Fit) -> float:
    """Of the covariance: all deviations summed exactly, over n^3."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = 0, 0.0
        for _, rows in _blocks(batches, fit.d):
            exact = fit.deviations(rows)
            if exact is None:
                rest += float((fit.centred(rows) ** 2).sum())
            else:
                whole += sum(exact.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(whole)], pa.decimal128(38, 0)), pa.array([rest])], ["whole", "rest"])

    got = x.mapInArrow(apply, "whole decimal(38,0), rest double").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest")).first()
    return int(got["whole"]) / fit.n**3 + got["rest"] / fit.n


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """The block's columns made orthonormal and orthogonal to the basis; a column that vanishes is replaced by a random one, as long as there is room."""
    out = basis
    for column in block.T:
        least = 100 * _EPS * scale
        while out.shape[1] < len(column):
            for _ in range(2):
                column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size > least:
                column = column / size
                column = column - out @ (out.T @ column)
                out = np.column_stack([out, column / np.linalg.norm(column)])
                break
            column, least = rng.standard_normal(len(column)), 0.0  # breakdown: start anew outside the basis
    return out[:, basis.shape[1] :]


def eigenpairs(image: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, most: int = MAX_BASIS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors of the symmetric operator that maps a block by `image`."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    most = max(most, 2 * wanted + 2 * block)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = _orthogonal(rng.standard_normal((d, min(block, d))), basis, 0.0, rng)
    confirmed, best, stalled = 0, np.inf, 0
    while True:
        own = image(fresh)
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, own])
        t = basis.T @ images
        values, ritz = np.linalg.eigh((t + t.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]
        top = ritz[:, : min(wanted, len(values))]
        vectors = basis @ top
        largest = max(float(np.abs(values).max()), np.finfo(np.float64).tiny)
        residual = float(np.linalg.norm(images @ top - vectors * values[: top.shape[1]], axis=0).max()) / largest
        full = basis.shape[1] == d
        if top.shape[1] == wanted:
            stalled = 0 if residual < best / 2 else stalled + 1
            best = min(best, residual)
        close = top.shape[1] == wanted and (residual <= tolerance or (residual <= 100 * tolerance and stalled >= 3))
        confirmed = confirmed + 1 if close else 0
        if full or confirmed > CONFIRM:
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        if basis.shape[1] + block > most:
            keep = ritz[:, : wanted + block]
            basis, images = basis @ keep, images @ keep
            own = images - basis * values[: keep.shape[1]]
            own = own[:, np.argsort(-np.linalg.norm(own, axis=0), kind="stable")[:block]]
        if confirmed == 1:
            own = rng.standard_normal((d, block))
        fresh = _orthogonal(own[:, : d - basis.shape[1]], basis, largest, rng)


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integers(vectors, column, key)
    fit = fit_list(x)
    if fit is None:
        return spark.createDataFrame([], schema)

    def image(q: np.ndarray) -> np.ndarray:
        def of(rows: np.ndarray) -> np.ndarray:
            c = fit.centred(rows)
            return c.T @ (c @ q)

        return _added(x, fit.d, fit.d, q.shape[1], of) / fit.n

    values, u = eigenpairs(image, fit.d, components, block)
    kept = values > 8 * fit.d * _EPS * max(values[0], 0)
    values, u = values[kept], u[:, kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    explained = values / trace(x, fit)
    p = u / np.sqrt(values)

    def outer(rows: np.ndarray) -> np.ndarray:
        w = fit.centred(rows) @ p
        return w.T @ w

    error = float(np.abs(_added(x, fit.d, k, k, outer) / fit.n - np.eye(k)).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _blocks(batches, fit.d):
            m = len(rows)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array(fit.long_deviations(rows), pa.int64()).take(pa.array(each)),
                    pa.array((fit.centred(rows) @ p).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(apply, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
