"""Whitening of embeddings along the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never built. All the solver asks for is its product with a few
vectors, which is one pass over the written fit list: a task centres its rows,
multiplies, and returns one small sum. Every step of the inner solver serves all
open pairs with one such pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgauge.llm.common import written

SCALE = 256
COMPONENTS = 4
SUBSPACE = 32
INNER = 4
OUTER = 200
ROWS = 4096
MANY_TASKS, GROUPS = 1024, 64
# A residual this small against the largest eigenvalue is the rounding of the products themselves.
PRECISION = 256 * np.finfo(float).eps
_LONG = 1 << 62

Product = Callable[[np.ndarray], np.ndarray]


def _unit(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``columns`` add to the orthonormal ``against``."""
    out = against
    for column in columns.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out[:, against.shape[1] :]


def corrections(product: Product, theta: np.ndarray, kept: np.ndarray, residuals: np.ndarray, steps: int, shrink: float) -> np.ndarray:
    """Columns t that about solve (I - KK')(V - theta I)(I - KK') t = -r, by MINRES in step.

    Each column has its own recurrence and shift; one ``product`` a step serves all.
    """

    def projected(x: np.ndarray) -> np.ndarray:
        x = x - kept @ (kept.T @ x)
        return x - kept @ (kept.T @ x)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    v = projected(-residuals)
    size = np.linalg.norm(v, axis=0)
    first, eta = size.copy(), size.copy()
    x, before, w, w_before = (np.zeros_like(v) for _ in range(4))
    cos = cos_before = np.ones(len(theta))
    sin = sin_before = np.zeros(len(theta))
    for _ in range(steps):
        v = over(v, size)
        image = projected(product(v) - theta * v)
        along = np.einsum("ij,ij->j", v, image)
        after = image - along * v - size * before
        size_after = np.linalg.norm(after, axis=0)
        a0 = cos * along - cos_before * sin * size
        a1 = np.hypot(a0, size_after)
        a2 = sin * along + cos_before * cos * size
        a3 = sin_before * size
        w, w_before = over(v - a3 * w_before - a2 * w, a1), w
        cos, cos_before, sin, sin_before = over(a0, a1), cos, over(size_after, a1), sin
        x = x + cos * eta * w
        eta = -sin * eta
        before, v, size = v, after, size_after
        if (np.abs(eta) <= shrink * first).all():
            break
    return x


def jacobi_davidson(
    product: Product, dims: int, k: int = COMPONENTS, subspace: int = SUBSPACE, inner: int = INNER, outer: int = OUTER, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive product.

    Rayleigh-Ritz on a growing subspace; open pairs extend it by their
    corrections, pairs whose residual is rounding are locked: they stay in the
    projection and get no more corrections. The result is confirmed by fresh
    products. With ``subspace`` directions the best half starts anew.
    """
    k, subspace = min(k, dims), max(subspace, 2 * k)
    none = np.zeros((dims, 0))
    basis = _unit(np.random.default_rng(seed).standard_normal((dims, min(dims, k + 2))), none)
    images = product(basis)
    confirmed, best, idle = False, np.inf, 0
    for turn in range(outer):
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        theta, turned = values[order][:k], turned[:, order]
        vectors = basis @ turned[:, :k]
        gaps = images @ turned[:, :k] - vectors * theta
        scale = max(theta[0], 0.0)
        sizes = np.linalg.norm(gaps, axis=0)
        open_pairs = np.flatnonzero(sizes > PRECISION * scale)
        worst = sizes.max(initial=0.0)
        idle = idle + 1 if worst >= best / 2 else 0
        best = min(best, worst)
        at_rest = idle >= 8 and worst <= 64 * PRECISION * scale
        if not len(open_pairs) or basis.shape[1] == dims or at_rest:
            if confirmed:
                return theta, vectors
            basis = _unit(basis @ turned[:, : max(k, min(basis.shape[1], subspace // 2))] if basis.shape[1] < dims else basis, none)
            images, confirmed = product(basis), True
            continue
        confirmed = False
        found = corrections(product, theta[open_pairs], vectors, gaps[:, open_pairs], inner, 0.5 ** min(turn + 1, 20))
        if basis.shape[1] + len(open_pairs) > subspace:
            half = turned[:, : max(k, subspace // 2)]
            basis, images = basis @ half, images @ half
        added = _unit(np.column_stack([found, gaps[:, open_pairs]]), basis)[:, : dims - basis.shape[1]]
        if not added.shape[1]:
            added = _unit(np.random.default_rng([seed, turn]).standard_normal((dims, 1)), basis)
        basis, images = np.column_stack([basis, added]), np.column_stack([images, product(added)])
    raise ArithmeticError(f"residual {worst:.3g} after {outer} turns")


def finite(vector: Column) -> Column:
    """Not null, without null, NaN or infinite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(256 * c) of each entry as long."""
    return F.transform(vector, lambda c: F.floor(c * SCALE))


@dataclass(frozen=True)
class Centre:
    """Row count and exact sums of the fit list; ``wide`` if a long cannot hold what is computed from them."""

    n: int
    sums: tuple[int, ...]
    wide: bool

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        kind = object if self.wide else np.int64
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n).astype(np.float64)


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    n, sums, most = 0, [0] * dims, 0
    for _, x in _matrices(batches, dims):
        high, low = x >> 32, x & 0xFFFFFFFF
        sums = [s + (int(h) << 32) + int(v) for s, h, v in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
        most = max(most, int(x.max()), -int(x.min()))
        n += len(x)
    if n:
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(dims), pa.int32()), "s": pa.array([str(s) for s in sums]), "n": pa.array([n] * dims, pa.int64()),
            "most": pa.array([str(most)] * dims),
        })


def _passed(batches: Iterator[pa.RecordBatch], dims: int, centre: Centre, use: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row: what ``use`` gives for the centred rows of this task, added up with compensation."""
    total, lost = None, None
    for _, x in _matrices(batches, dims):
        part = use(centre.centred(x)).ravel()
        if total is None:
            total, lost = part, np.zeros_like(part)
            continue
        after = total + part
        lost += np.where(np.abs(total) >= np.abs(part), (total - after) + part, (part - after) + total)
        total = after
    if total is not None:
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "v": pa.array([(total + lost).tolist()], pa.list_(pa.float64()))})


def _group_sum(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")
    return pd.DataFrame({"task": rows["task"].iloc[:1], "v": [np.stack(rows["v"].to_numpy()).sum(axis=0)]})


class FitList:
    """The distinct scaled vectors, written once; every figure is one pass over them."""

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims = written(rows.select("x").distinct(), "fit-list"), dims
        # Only how partial sums travel depends on this: many would be too much for the driver at once.
        self.many = self.rows.rdd.getNumPartitions() > MANY_TASKS
        parts = self.rows.mapInArrow(partial(_moments, dims=dims), "i int, s string, n bigint, most string")
        big = "decimal(38,0)"
        found = parts.groupBy("i").agg(
            F.sum(F.col("s").cast(big)).cast("string").alias("s"), F.sum("n").alias("n"), F.max(F.col("most").cast(big)).cast("string").alias("most")
        ).orderBy("i").collect()
        n, most = (found[0]["n"], int(found[0]["most"])) if found else (0, 0)
        self.centre = Centre(n, tuple(int(r["s"]) for r in found), dims * (2 * n * most) ** 2 >= _LONG)

    def total(self, use: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        parts = self.rows.mapInArrow(partial(_passed, dims=self.dims, centre=self.centre, use=use), "task int, v array<double>")
        if self.many:
            parts = parts.groupBy(F.col("task") % GROUPS).applyInPandas(_group_sum, parts.schema)
        found = sorted(parts.collect(), key=lambda r: r["task"])
        return np.stack([np.array(r["v"]) for r in found]).sum(axis=0)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times ``columns``."""
        return self.total(partial(_times, columns=columns)).reshape(columns.shape) / self.centre.n


def _times(centred: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return centred.T @ (centred @ columns)


def _energy(centred: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->", centred, centred).reshape(1)


def _second_moment(centred: np.ndarray, projection: np.ndarray) -> np.ndarray:
    w = centred @ projection
    return w.T @ w


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues (falling), unit eigenvectors as columns, and how far whitened rows are from unit covariance."""

    centre: Centre
    dims: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, dims: int, k: int = COMPONENTS, **options: int) -> Whitening:
    """The leading components of (x) rows with ``dims`` entries each. Components without variance are left out."""
    rows = FitList(rows, dims)
    none = Whitening(rows.centre, dims, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    if not rows.centre.n:
        return none
    trace = float(rows.total(_energy)[0]) / rows.centre.n
    if trace <= 0:
        return none
    values, vectors = jacobi_davidson(rows.product, dims, k, **options)
    real = values > PRECISION * dims * values[0]
    found = Whitening(rows.centre, dims, values[real], vectors[:, real], trace, 0.0)
    moment = rows.total(partial(_second_moment, projection=found.projection)).reshape(real.sum(), -1) / rows.centre.n
    return Whitening(rows.centre, dims, found.values, found.vectors, trace, float(np.abs(moment - np.eye(len(moment))).max()))


def _apply(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for part, x in _matrices(batches, model.dims):
        offsets = model.centre.offsets(x)
        deviation = (offsets * offsets).sum(axis=1)
        white = (offsets / model.centre.n).astype(np.float64) @ model.projection
        rows = np.repeat(np.arange(len(x)), k)
        yield pa.RecordBatch.from_pydict({
            "vec_id": part.column("vec_id").take(pa.array(rows)),
            "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
            "n": pa.array(np.full(len(rows), model.centre.n, dtype=np.int64)),
            "deviation": pa.array(deviation, pa.int64()).take(pa.array(rows)),
            "whitened": pa.array(white.ravel()),
            "explained": pa.array(np.tile(model.values / model.trace, len(x))),
            "identity_error": pa.array(np.full(len(rows), model.identity_error)),
        })


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", **options: int) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row on each leading component.

    Rows with a null vector or a null or non-finite entry go. Repeated rows and
    rows with a null id each get their own results; the fit list holds a vector
    once. All vectors should be of one length: rows of another length than most
    have (ties: the longer) are not in the space and give no rows, nor do empty
    vectors. Components without variance are left out, so equal vectors, one row
    or no rows give no rows. Equal eigenvalues may come as any unit vectors of
    their plane. Entries beyond a long after scaling count as its end; a
    deviation that no long holds is an error. Other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    rows = rows.select("vec_id", scaled(F.col("v")).alias("x"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == usual["d"])
    model = fit(rows, usual["d"], k, **options)
    if not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_apply, model=model), schema)
