"""Whitening of embeddings by shifted CholeskyQR.

Vectors are made whole numbers, x = floor(256 * c). The distinct ones are the fit list, a table in the shared folder. Each pass over it applies the
triangular solves so far to the centred rows and sums their Gram matrix over the cluster; its Cholesky factor (of the first pass with a shift, so that
it exists for any data) makes the rows of the next pass more nearly orthonormal. The product of the factors is R, and the singular
value decomposition of R, with what the last Gram matrix still lacks, gives the components. The driver only sees d x d matrices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import record, shared_folder

SCALE = 256
COMPONENTS = 4
#: Passes over the fit list until the rows are orthonormal to ORTHONORMAL; three do unless the data has fewer dimensions than columns.
MAX_PASSES, ORTHONORMAL = 6, 1e-13
#: Singular values below this share of the largest are zero.
RANK = 1e-11
_SAFE = 2**62
#: Doubles of a block of rows in a task.
_BLOCK = 1 << 20


def whole_numbers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is not null and holds finite numbers only."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as a matrix."""
    rows = max(1, _BLOCK // dim)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


@dataclass
class Centre:
    """n rows with the sums S of each dimension."""

    n: int
    sums: list[int]
    wide: int = field(init=False)

    def __post_init__(self) -> None:
        self.wide = max(map(abs, self.sums), default=0)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; as Python's integers where 64 bits don't hold it."""
        if self.n * _largest(x) + self.wide < _SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 over the dimensions, exactly; None where a long doesn't hold it."""
        apart = self.apart(x)
        if apart.dtype != object and _largest(apart) ** 2 * max(x.shape[1], 1) < 2**63:
            return (apart * apart).sum(axis=1).tolist()
        exact = (apart.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in exact]


def centre_of(fit: DataFrame, dim: int) -> Centre:
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for _, x in _blocks(batches, 0, dim):
            n += len(x)
            own = x.sum(axis=0) if _largest(x) * len(x) < _SAFE else x.astype(object).sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, own, strict=True)]
        if n:
            yield record(schema, [list(range(dim)), [n] * dim, [Decimal(s) for s in sums]])

    got = fit.mapInArrow(run, "at int, n long, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return Centre(got[0]["n"], [int(r["s"]) for r in got]) if got else Centre(0, [])


def gram(fit: DataFrame, dim: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of a transposed with a over all blocks, a = rows_of(x) with `width` columns: each task sums its own blocks, and the rows of the tasks'
    matrices meet by their number."""
    schema = pa.schema([("at", pa.int32()), ("row", pa.list_(pa.float64()))])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _blocks(batches, 0, dim):
            a = rows_of(x)
            total += a.T @ a
        if total.any():
            yield record(schema, [list(range(width)), total.tolist()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), strict=True):
                held[at] = held.get(at, 0) + row
        if held:
            yield record(schema, [list(held), [r.tolist() for r in held.values()]])

    kind = "at int, row array<double>"
    out = np.zeros((width, width))
    for r in fit.mapInArrow(own, kind).repartition("at").mapInArrow(merged, kind).collect():  # one row for each of `width`
        out[r["at"]] = r["row"]
    return (out + out.T) / 2


def solved(a: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """a times the inverse of an upper triangular matrix, by substitution."""
    out = np.empty_like(a)
    for j in range(a.shape[1]):
        out[:, j] = (a[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _shifted(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g plus the shift, or plus ten times as much until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).tiny)


def _root(g: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(g)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def triangle(fit: DataFrame, centre: Centre, dim: int) -> np.ndarray:
    """A matrix whose product with itself, transposed first, is that of the centred rows; upper triangular but for rounding."""
    factors: list[np.ndarray] = []

    def rows_of(x: np.ndarray) -> np.ndarray:
        a = centre.centred(x)
        for upper in factors:
            a = solved(a, upper)
        return a

    whole = np.eye(dim)
    g = gram(fit, dim, dim, rows_of)
    while len(factors) < MAX_PASSES and (not factors or np.abs(g - np.eye(dim)).max() > ORTHONORMAL * dim):
        shift = np.finfo(float).eps / 2 * 11 * (centre.n * dim + dim * (dim + 1)) * max(float(np.linalg.eigvalsh(g)[-1]), 0.0)
        try:
            upper = np.linalg.cholesky(g + (0 if factors else shift) * np.eye(dim)).T
        except np.linalg.LinAlgError:  # dimensions in which the rows don't vary
            upper = _shifted(g, shift)
        factors.append(upper)
        whole = upper @ whole
        g = gram(fit, dim, dim, rows_of)
    return _root(g) @ whole


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray  # eigenvalues of the covariance, falling, positive ones only
    vectors: np.ndarray  # a column for each
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """From a table of distinct vectors x of `dim` whole numbers."""
    centre = centre_of(fit, dim)
    if centre.n == 0:
        return Whitening(centre, np.zeros(0), np.zeros((dim, 0)), 0.0)
    _, sizes, rows = np.linalg.svd(triangle(fit, centre, dim))
    values = sizes**2 / centre.n
    use = [k for k in range(min(components, dim)) if sizes[k] > RANK * sizes[0] and sizes[k] > 0]
    vectors = rows[use].T
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(use))]) if use else np.ones(0)
    return Whitening(centre, values[use], vectors * sign, float(values.sum()))


def identity_error(fit: DataFrame, dim: int, whitening: Whitening) -> float:
    """Largest absolute entry of the projected fit list's covariance minus the identity."""
    k, n = len(whitening.values), whitening.centre.n
    ones = lambda x: np.hstack([whitening.project(x), np.ones((len(x), 1))])  # noqa: E731  the last row holds the sums
    g = gram(fit, dim, k + 1, ones)
    mean = g[k, :k] / n
    return float(np.abs(g[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Rows whose vector is null or holds null or non-finite numbers are left out. Equal vectors, by x, count once in the fit and each give
    their rows; so do repeated ids and null ones. Shorter vectors are taken to end in zeros (an empty one is all zeros). Components
    whose eigenvalue is zero don't exist: a table with one distinct vector, or none, gives no rows. A component's largest loading is positive;
    components of equal eigenvalues are some basis of theirs. deviation is null where a long can't hold it. Numbers of 2^63 / 256 and
    more count as the largest long. Further columns aren't read.
    """
    spark = table.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(table, id_col, vector_col)
    dim = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if not dim or dim < 1:
        return spark.createDataFrame([], kind)
    zeros = F.array_repeat(F.lit(0).cast("long"), (F.lit(dim) - F.size("x")).cast("int"))
    rows = rows.withColumn("x", F.concat("x", zeros))
    place = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(place)
    fit = spark.read.schema("x array<long>").parquet(place)
    made = fit_whitening(fit, dim, components)
    count = len(made.values)
    if not count:
        return spark.createDataFrame([], kind)
    error = identity_error(fit, dim, made)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    explained = made.values / made.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 1, dim):
            ids, deviation = (np.repeat(np.array(v, dtype=object), count).tolist() for v in (batch.column(0).to_pylist(), made.centre.deviation(x)))
            size = len(ids)
            yield record(schema, [ids, np.tile(np.arange(1, count + 1), len(x)), np.full(size, made.centre.n), deviation, made.project(x).ravel(), np.tile(explained, len(x)), np.full(size, error)])

    return rows.mapInArrow(run, kind)
