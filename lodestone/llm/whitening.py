"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import map_arrow, stored

SEED = 42
#: Residuals, as shares of the largest singular value, at which a wanted direction
#: is final, and at which a later sweep has shown what its largest value is.
FINAL, SHOWN = 1e-15, 1e-8


@dataclass
class Whitening:
    """A fit: ``n`` vectors with ``sums`` per dimension; unit eigenvectors of
    their covariance (columns) by falling eigenvalue, and its trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    steps: int


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and x, floor(256 * entry) of each entry, of the rows that have a
    vector of finite entries of the table's length (the most frequent length
    above zero; of equally frequent ones the longest)."""
    entry = F.col("embedding")
    unfit = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(entry.isNotNull() & (F.size(entry) > 0) & ~unfit)
    common = rows.groupBy(F.size(entry).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * 256.0))
    return rows.filter(F.size(entry) == (common["d"] if common else 0)).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(fit: DataFrame, each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of what ``each`` gives for a block of them: one
    array a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "part"])

    rows = fit.mapInArrow(run, f"i int, part {kind}").groupBy("i").agg(F.sum("part").alias("total")).collect()
    return np.array([r["total"] for r in sorted(rows)])


def bidiagonal(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], size: int, scale: float, wanted: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, alphas, betas) with X V = U B, B upper bidiagonal, for a matrix X of ``size`` columns
    and Frobenius norm ``scale``, as far as its ``wanted`` leading directions need it.

    ``product(w, W)`` gives Xᵀz, UᵀZ and zᵀz for z = Xw and U = XW. A left vector is a
    combination of X's columns, so its few coefficients (a column of W) stand for it; what a
    new one shares with the earlier is known from their products Xᵀu, is taken off before the
    vector is formed, and once more by the inner products of the vectors themselves. Right
    vectors are orthogonalised twice against all earlier ones. A sweep ends when its
    leading directions are final, or when its space is exhausted. Another one starts from a
    new vector orthogonal to all found: a repeated value shows in it. The last sweep is
    one whose largest value doesn't reach the wanted ones.
    """
    rng = np.random.default_rng(SEED)
    V, W, G = (np.zeros((size, 0)) for _ in range(3))  # right vectors, coefficients of left ones, Xᵀ times left ones
    alphas: list[float] = []
    betas: list[float] = []
    tiny = 1e-14 * scale

    def orthogonal(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - V @ (V.T @ y)
        return y

    def fresh() -> np.ndarray:
        while True:
            y = orthogonal(rng.standard_normal(size))
            if np.linalg.norm(y) > 1e-8:
                y = orthogonal(y / np.linalg.norm(y))
                return y / np.linalg.norm(y)

    first, reached = 0, np.inf
    v = fresh()
    while True:
        w = v - W @ (G.T @ v)
        y, shared, square = product(w, W)
        w, y = w - W @ shared, y - G @ shared
        alpha = float(np.sqrt(max(0.0, square - shared @ shared)))
        known = alpha > tiny
        V = np.column_stack([V, v])
        W = np.column_stack([W, w / alpha if known else np.zeros(size)])
        G = np.column_stack([G, y / alpha if known else np.zeros(size)])
        alphas.append(alpha if known else 0.0)
        if V.shape[1] == size:
            return V, np.array(alphas), np.array(betas)
        y = orthogonal(G[:, -1] - alphas[-1] * v)
        beta = float(np.linalg.norm(y))
        left, values, _ = np.linalg.svd(_bidiagonal(alphas[first:], betas[first:]))
        residual = beta * np.abs(left[-1])
        most = max(values[0], reached if first else 0.0)
        final = beta <= tiny or (len(values) > wanted and (residual[:wanted] <= FINAL * most).all())
        below = first > 0 and values[0] <= reached and (beta <= tiny or residual[0] <= SHOWN * most)
        if below:
            return V, np.array(alphas), np.array(betas)
        if final:
            betas.append(0.0)
            all_values = np.linalg.svd(_bidiagonal(alphas, betas[:-1]), compute_uv=False)
            first, reached = V.shape[1], all_values[wanted - 1] if len(all_values) >= wanted else 0.0
            v = fresh()
        else:
            betas.append(beta)
            v = orthogonal(y / beta)
            v /= np.linalg.norm(v)


def _bidiagonal(alphas, betas) -> np.ndarray:
    return np.diag(np.asarray(alphas)) + np.diag(np.asarray(betas), 1)


def fit(x: DataFrame, components: int = 4) -> Whitening:
    """The leading ``components`` of the distinct vectors in ``x`` (rows of equal length).

    ``x`` is read once a step, by tasks that hold a block of centred vectors, the earlier left
    vectors' coefficients, and their own sums. Directions without any spread aren't components, so
    there are fewer where the vectors have fewer, and none for fewer than two vectors.
    """
    sizes = _summed(x, lambda m: np.r_[len(m), m.sum(axis=0)].astype(np.int64), "long")
    if not len(sizes):
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    n, sums = int(sizes[0]), sizes[1:]
    mean, size = sums / n, len(sums)
    spread = float(_summed(x, lambda m: np.array([np.square(m - mean).sum()]))[0])
    if spread == 0:
        return Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0, 0)

    def product(w, W):
        def each(m):
            centred = m - mean
            z = centred @ w
            return np.r_[centred.T @ z, (centred @ W).T @ z, z @ z]

        found = _summed(x, each)
        return found[:size], found[size:-1], float(found[-1])

    V, alphas, betas = bidiagonal(product, size, np.sqrt(spread), components)
    _, values, right = np.linalg.svd(_bidiagonal(alphas, betas[: len(alphas) - 1]))
    values = values[:components]
    values = values[values > 1e-12 * values[0]]
    vectors, _ = np.linalg.qr(V @ right[: len(values)].T)
    return Whitening(n, sums, vectors, values**2 / n, spread / n, len(alphas))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the covariance of the whitened vectors minus the identity."""
    mean, project = model.sums / model.n, model.vectors / np.sqrt(model.values)
    k = len(model.values)

    def each(m):
        y = (m - mean) @ project
        return np.r_[y.sum(axis=0), (y.T @ y).ravel()]

    found = _summed(x, each) / model.n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row
    for each vector and component.

    Rows without a vector, or with a null, NaN or infinite entry, are left out;
    so are vectors of another length than most (see ``scaled``) and empty ones.
    Entries become whole numbers, floor(256 * entry), which must stay within
    64 bits when n of them are added. The fit takes each distinct vector
    once, however often it is repeated; every remaining row is whitened, also
    rows that repeat and those with a null vec_id. deviation is exact, or null
    where it is beyond 64 bits. Fewer components than asked for come out where
    the vectors spread in fewer directions, and no rows if they are all equal
    or the table is empty. Other columns are ignored.
    """
    rows = scaled(vectors)
    distinct = stored(rows.select("x").distinct())
    model = fit(distinct, components)
    kind = dict(vectors.dtypes)["vec_id"]
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame(
            [],
            f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
        )
    n, sums = model.n, model.sums
    mean, project = sums / n, model.vectors / np.sqrt(model.values)
    error = identity_error(distinct, model)

    def each(batch):
        m = _matrix(batch)
        white = (m - mean) @ project
        ends = pa.array(np.arange(0, white.size + 1, k, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pa.array((m * m).sum(axis=1)),
                pa.array(m @ sums),
                pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
            ],
            names=["vec_id", "square", "along", "white"],
        )

    def whole(value):
        return F.lit(str(value)).cast("decimal(38,0)")

    spread = map_arrow(rows, each, f"vec_id {kind}, square long, along long, white array<double>")
    all_squares = sum(int(s) ** 2 for s in sums)
    deviation = whole(n * n) * F.col("square") - whole(2 * n) * F.col("along") + whole(all_squares)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return spread.select("vec_id", deviation.try_cast("long").alias("deviation"), F.posexplode("white").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
