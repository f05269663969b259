"""Whitening of embeddings by spectral divide and conquer on their covariance.

Entries become whole numbers floor(scale * c) + shift, so that equal vectors are found exactly, and sums
and deviations are exact. The fit list holds each distinct vector once. Its sums, its centred products
and, as a check, those of its whitened vectors are added up per task and then by a grouping; what
reaches the driver is a row per pair of dimensions, however many vectors there are.

The covariance, a matrix of dimension d, is split on the driver: the polar factor of the matrix less a
shift, by QDWH iterations, tells the invariant subspace of the eigenvalues above the shift from the one below;
each is split again until subspaces of one dimension, the components, are left. Subspaces beyond the
wanted components are not split. Rows are then projected on the components, which every task gets.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left out. Vectors must
have one length; of several lengths the most frequent one counts (of those the longest) and the others
are left out. Entries beyond 2^52 count as 2^52. A deviation that does not fit a long is null. Directions in
which the vectors do not vary (an eigenvalue below 10^-12 of the largest) are no components: one distinct
vector, or an empty table, gives no rows. Null ids stay null, repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.stages import settle

LARGEST = float(1 << 52)
FLAT = 1e-12  # eigenvalues below this share of the largest are no directions of the data
ROUNDING = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by QDWH; None if it is as good as singular."""
    n = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return None
    x = a / norm
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        return None
    if not low > 10 * ROUNDING:
        return None
    for _ in range(50):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        last = x
        if wc > 100:  # the stacked QR keeps small singular values right
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.solve(np.eye(n) + wc * (x.T @ x), x.T).T
            x = wb / wc * x + (wa - wb / wc) * z
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if np.linalg.norm(x - last) < np.cbrt(5 * ROUNDING) and 1 - low < 10 * ROUNDING:
            return x
    return None


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below some shift; None if all eigenvalues are one."""
    n, mean = len(a), float(np.trace(a)) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= n * ROUNDING * np.linalg.norm(a):
        return None
    nearby = [mean + spread / n * f for f in (0, 0.11, -0.13, 0.31, -0.37, 0.53, -0.59, 0.83, -0.89)]
    best, rng = None, np.random.default_rng(n)
    for shift in [float(np.median(np.diag(a))), *nearby]:
        unitary = polar(a - shift * np.eye(n))
        if unitary is None:
            continue
        above = (unitary + np.eye(n)) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < n:
            continue
        # Two steps of subspace iteration on a projector, whose eigenvalues are one and zero.
        upper, _ = np.linalg.qr(above @ rng.standard_normal((n, k)))
        upper, _ = np.linalg.qr(above @ upper)
        whole, _ = np.linalg.qr(np.hstack((upper, rng.standard_normal((n, n - k)))))
        lower, _ = np.linalg.qr(whole[:, k:] - above @ whole[:, k:])
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
        mixed = np.linalg.norm(lower.T @ a @ upper)
        if best is None or mixed < best[0]:
            best = mixed, upper, lower
        if mixed <= 10 * n * ROUNDING * np.linalg.norm(a):
            break
    return best and best[1:]


def principal(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors."""
    stack, values, vectors = [(a, np.eye(len(a)))], [], []
    while stack and len(values) < wanted:  # the part with the largest eigenvalues is on top
        part, basis = stack.pop()
        halves = _halves(part) if len(part) > 1 else None
        if halves is None:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for half in reversed(halves):
            inner = half.T @ part @ half
            stack.append(((inner + inner.T) / 2, basis @ half))
    values, vectors = np.array(values), np.array(vectors).reshape(-1, len(a))
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[order]
    return values[order], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """The entries of a vector as longs; `vector` holds finite numbers only."""

    def one(c: Column) -> Column:
        near = F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(near) + F.lit(shift).cast("long")

    return F.transform(vector, one)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """n vectors with sums S: deviations from the mean, exact as whole numbers and as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 of each row."""
        near = self.centred(x) * float(self.n)
        fits = (near * near).sum(axis=1) < 2.0**62
        steps = np.where(fits[:, None], x - self.base, 0) * self.n - self.rest
        exact = (steps * steps).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(~fits).tolist():
            whole = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums, strict=True))
            out[i] = whole if whole < 1 << 63 else None
        return out


def _products(fit: DataFrame, d: int, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """The mean of the products of the centred (and projected) vectors of the fit list."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = centre.centred(_matrix(batch.column(0), d))
            x = x if project is None else x @ project
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"]
            )

    size = d if project is None else project.shape[1]
    out = np.zeros((size, size))
    for r in fit.mapInArrow(added, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / centre.n
    return out


def _clean(rows: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): the rows that count, their entries as whole numbers."""

    def unusable(c: Column) -> Column:
        c = c.cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    return (
        rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
        .where(F.col("vector").isNotNull())
        .where(~F.exists("vector", unusable))
        .select("vec_id", whole_numbers(F.col("vector"), scale, shift).alias("x"))
    )


def whiten(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
) -> DataFrame:
    """Per row and component up to `components`: vec_id, component (from 1, by falling eigenvalue), n (size
    of the fit list), deviation (of the row, exact), whitened, explained (share of the variance) and
    identity_error (largest entry of the whitened covariance less the identity, measured)."""
    clean = _clean(rows, vec_id, vector, scale, shift)
    kind = clean.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    lengths = clean.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.where("d > 0").orderBy(F.desc("rows"), F.desc("d")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = common["d"]
    clean = clean.where(F.size("x") == d)
    fit = settle(clean.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "fit")
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    centre = Centre(n, [int(r.s) for r in sums.orderBy("i").collect()])
    covariance = _products(fit, d, centre)
    trace = float(np.trace(covariance))
    values, vectors = principal(covariance, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((0, d)))
    real = values > FLAT * values[:1].max(initial=0)
    values, vectors = values[real], vectors[real]
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    project = (vectors / np.sqrt(values)[:, None]).T
    error = float(np.abs(_products(fit, d, centre, project) - np.eye(k)).max())
    explained = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                m, x = batch.num_rows, _matrix(batch.column(1), d)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array((centre.centred(x) @ project).reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return clean.mapInArrow(projected, schema)
