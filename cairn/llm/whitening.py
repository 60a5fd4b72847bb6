"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V = XᵀX / n of the centred vectors X is never formed. Each pass over the fit list computes
Z = XᵀX Q / n for a block Q of orthonormal columns: tasks multiply their rows, and the partial sums, as large as the
block, are added by a shuffle. The driver takes the Ritz pairs of QᵀZ, their residuals |V u - e u|, and the QR
factor of Z as the next block. Residuals at rounding level certify the components. Where they fall too slowly, because
an eigenvalue outside the block is nearly as large as the last one wanted, the block grows; at full width it holds
every eigenvector, so the iteration always ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..tables import discard, staged

#: Residual of a certified component, as a share of the largest eigenvalue.
TOLERANCE = 2e-14
#: The residuals have to reach the tolerance within so many passes at their present rate, or the block grows.
PATIENCE = 6
#: Entries are numbers below this; x is then exact in a double.
LARGEST = float(1 << 46)
#: Vectors multiplied at once.
ROWS = 4096


def fixed_point(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c as array<long>; null if the vector or an entry is null or not finite.

    Entries of 2^46 and more, whose x would not be exact, count as not finite.
    """
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000).cast("long")))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _summed(table: DataFrame, dim: int, width: int, part) -> np.ndarray:
    """The sum over all rows of part(x): a matrix of `dim` rows and `width` columns, x being (rows, dim) of longs.

    A task sends `dim` rows, whatever it reads, and the driver gets `dim` rows in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), ROWS):
                own = part(x[at : at + ROWS])
                total = own if total is None else total + own
        if total is not None:
            kind = pa.int64() if total.dtype == np.int64 else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, c], kind) for c in range(width))], ["i", *(f"c{c}" for c in range(width))])

    kind = "long" if part(np.zeros((1, dim), np.int64)).dtype == np.int64 else "double"
    parts = table.select("x").mapInArrow(run, "i int, " + ", ".join(f"c{c} {kind}" for c in range(width)))
    rows = parts.groupBy("i").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)]).collect()
    return np.array([list(r)[1:] for r in sorted(rows)])


@dataclass
class Whitening:
    """What a fit has found. `explained` are shares of trace(V); `residual` is the largest of |V u - e u| / e1."""

    dim: int
    n: int
    total: list[int]
    mean: np.ndarray
    components: np.ndarray  # (dim, k), unit columns
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    residual: float
    passes: int


def orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def subspace(product, dim: int, k: int, block: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(values, unit vectors as columns, residual, passes) of the `k` largest eigenpairs of the symmetric V = product(.).

    `product` gives V Q for a (dim, b) block; each call is a pass. Starts are random but the same at every call.
    """
    rng = np.random.default_rng(seed)
    k, block = min(k, dim), min(dim, max(block, k))
    q, passes, before, best = orthonormal(rng.standard_normal((dim, block))), 0, np.inf, None
    while True:
        z = product(q)
        passes += 1
        h = q.T @ z
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        vectors = q @ y[:, :k]
        size = max(abs(values[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(z @ y[:, :k] - vectors * values[:k], axis=0).max() / size)
        if best is None or residual < best[2]:
            best = values[:k], vectors, residual
        # The second test: a full block that has been multiplied twice can't do better than rounding.
        if residual <= TOLERANCE or q.shape[1] == dim and residual > before / 2:
            return *best, passes
        rate = residual / before if np.isfinite(before) else 0
        grow = q.shape[1] < dim and (rate >= 1 or 0 < rate and np.log(TOLERANCE / residual) / np.log(rate) > PATIENCE)
        before = residual
        if grow:
            z = np.hstack([z @ y, rng.standard_normal((dim, min(q.shape[1], dim - q.shape[1]))) * size])
            before = np.inf
        else:
            z = z @ y
        # Columns are scaled, so that small ones keep their digits; twice, for orthogonality to rounding.
        z = z / np.maximum(np.linalg.norm(z, axis=0), np.finfo(float).tiny)
        q = orthonormal(orthonormal(z))


def fit(vectors: DataFrame, k: int = 16, block: int | None = None) -> Whitening | None:
    """Whitening of the distinct `x` (array<long>) of `vectors`; None if there are none.

    All x must have one length. Components whose eigenvalue is zero, to rounding, are left out, as nothing
    can be whitened along them: fewer than k distinct vectors have fewer components, a single one none.
    """
    table = staged(vectors.select("x").distinct(), "distinct")
    first = table.select(F.size("x").alias("d")).first()
    if first is None or not first["d"]:
        return None
    dim, n = first["d"], table.count()
    total = [int(v) for v in _summed(table, dim, 1, lambda x: x.sum(axis=0, dtype=np.int64)[:, None])[:, 0]]
    whole, rest = np.array([t // n for t in total], np.int64), np.array([t % n for t in total], float) / n
    mean = np.array([t / n for t in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest  # whole numbers first: nothing is lost in the large part

    def product(q: np.ndarray) -> np.ndarray:
        return _summed(table, dim, q.shape[1], lambda x: (c := centred(x)).T @ (c @ q)) / n

    trace = float(_summed(table, dim, 1, lambda x: (centred(x) ** 2).sum(axis=0)[:, None]).sum() / n)
    values, components, residual, passes = subspace(product, dim, k, block or 2 * k)
    live = values > max(values[0], 0) * dim * np.finfo(float).eps
    values, components = values[live], components[:, live]
    error = 0.0
    if len(values):
        scaled = components / np.sqrt(values)

        def gram(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        sums = _summed(table, dim, len(values), gram) / n
        error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(values))).max())
    discard(table)
    return Whitening(dim, n, total, mean, components, values, values / trace if trace else values, error, residual, passes)


def transform(vectors: DataFrame, model: Whitening, id_kind: str) -> DataFrame:
    """A row per row of `vectors` (id, x) and component: id, component, deviation, whitened; see whiten()."""
    n, total, dim = model.n, np.array(model.total, np.int64), model.dim
    whole, rest = total // n, (total % n) / n
    scaled = model.components / np.sqrt(model.values)
    k = len(model.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        off = x - whole
        # n * x - S = n * (x - S // n) - S % n, which is small.
        most = (int(np.abs(off).max(initial=0)) + 1) * n
        if most < 1 << 31 and most * most * dim < 1 << 63:
            return ((n * off - total % n) ** 2).sum(axis=1).tolist()
        exact = ((off.astype(object) * n - (total % n).astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), dim)
                white = ((x - whole) - rest) @ scaled
                who = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(who), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(deviations(x), pa.int64()).take(who), pa.array(white.ravel())],
                    ["id", "component", "deviation", "whitened"],
                )

    return vectors.select("id", "x").mapInArrow(run, f"id {id_kind}, component int, deviation long, whitened double")


def whiten(df: DataFrame, k: int = 16, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable row of `df` and component, up to k: id, component (1: largest eigenvalue), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out. Entries become long x = floor(64 c) +
    1000000; n distinct x vectors with sums S are fitted. deviation is the sum of (n x - S)^2, null where a long can't
    hold it. whitened is x - S / n on the component over the root of its eigenvalue, explained that eigenvalue over
    trace(V), identity_error the largest entry of the covariance of whitened, over the fit list, minus the identity.

    Vectors of another length than most rows have (ties: the shorter) cannot be compared and are left out, as are vectors
    of length zero. Ids may be null or repeat: each row is whitened. Components without variance are left out, so
    a table of equal vectors, or an empty one, gives no rows. Other columns are not read.
    """
    kind = df.select(id_col).dtypes[0][1]
    rows = df.select(df[id_col].alias("id"), fixed_point(df[vector_col]).alias("x")).where("x IS NOT NULL")
    rows = staged(rows.withColumn("d", F.size("x")), "fixed")
    lengths = rows.where("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    model = None
    if lengths:
        rows = rows.where(F.col("d") == lengths["d"])
        model = fit(rows, k, block)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("component"))
    out = transform(rows, model, kind)
    return out.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
