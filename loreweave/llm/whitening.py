"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

X has the centred rows. From a start vector v the process alternates u = Xv and
v = Xᵀu; each new vector loses what lies along all earlier ones of its kind (full
reorthogonalisation), and its length is the next entry of a bidiagonal B with
X V = U B. The right singular vectors of the small B, turned by V, are those of X;
squares of singular values over n are the covariance's eigenvalues.

Rows are far too many for a u to be kept. Every u is Xp for a short p, so only p,
g = Xᵀu and the v are held, each as long as a vector is wide. One pass over the
rows makes both products of a step: a task forms Xv for its blocks, its inner
products with the earlier u (X P, block by block) and its share of XᵀXv. Shares
are added by Spark, entry by entry; the driver sees a few hundred numbers a step.

Up to ``WHOLE`` dimensions all steps are made; beyond, steps end once the wanted
triplets stand to double precision. Where a step breaks down, the next one starts
with a vector off all earlier ones, so repeated values are found too.

Rows travel as blocks of integers x = floor(scale * c) + shift. Centred rows are
(n x - S) / n, with n x - S whole.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import stored

BLOCK = 1024
#: x is held within these bounds, so that sums of a block are exact in 64 bits.
MOST = 2**50
LONG = 2**63 - 1
#: Dimensions up to which the bidiagonalisation is made whole.
WHOLE = 256
#: A component counts if its eigenvalue is over this part of the first one.
RANK = 1e-12

BLOCK_SQL = "ids array<long>, width int, size int, rows binary"


def _pack(scale: int, shift: int):
    """Rows (vec_id, embedding) as blocks of 64-bit integers, those of one width together."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                column = part.column("embedding")
                flat, width = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
                x = (np.clip(np.floor(flat * scale), -MOST, MOST) + shift).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(width)))
                for w in np.unique(width).tolist():
                    own = np.flatnonzero(width == w)
                    body = np.stack([x[at[i] : at[i] + w] for i in own])
                    body = body.astype(np.int32 if np.abs(body).max(initial=0) < 2**31 else np.int64)
                    ids = part.column("vec_id").take(pa.array(own)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([w], pa.int32()), pa.array([body.itemsize], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["ids", "width", "size", "rows"])

    return run


def own_rows(row: dict) -> np.ndarray:
    return np.frombuffer(row["rows"], f"i{row['size']}").astype(np.int64).reshape(len(row["ids"]), row["width"])


def integers(row: dict, width: int, shift: int) -> np.ndarray:
    """A block's rows x; what a vector lacks in width counts as zeros."""
    own = own_rows(row)
    return np.pad(own, ((0, 0), (0, width - row["width"])), constant_values=shift)


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _sums(batches):
    """(dimension, sum of x, rows that have it); dimension -1: all rows."""
    sums: dict[int, list[int]] = {}
    for row in _blocks(batches):
        x = own_rows(row)
        for i, s in enumerate([0, *x.sum(axis=0).tolist()], -1):
            own = sums.setdefault(i, [0, 0])
            own[0], own[1] = own[0] + s, own[1] + len(x)
    if sums:
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([Decimal(s) for s, _ in sums.values()], whole), pa.array([n for _, n in sums.values()], pa.int64())], ["i", "s", "n"])


class Centre:
    """The fit list's size and sums, and rows centred on them."""

    def __init__(self, n: int, sums: list[int], shift: int):
        self.n, self.sums, self.shift = n, sums, shift
        self.width = len(sums)

    def numerators(self, row: dict) -> np.ndarray:
        """n x - S, exact: 64-bit integers, or Python's where those don't reach."""
        x = integers(row, self.width, self.shift)
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, row: dict) -> np.ndarray:
        return self.numerators(row).astype(np.float64) / self.n

    def deviations(self, row: dict) -> np.ndarray:
        """Sums of squares of n x - S; beyond the range of longs, the largest long."""
        d = self.numerators(row)
        if d.dtype == object or np.square(d.astype(np.float64)).sum(axis=1).max(initial=0) >= 2**62:
            return np.array([min(LONG, sum(y * y for y in v)) for v in d.astype(object).tolist()], np.int64)
        return (d * d).sum(axis=1)


def _shares(shared, make: Callable[[Centre, dict], np.ndarray]):
    """A task's share of sums over rows, as (entry, value)."""

    def run(batches):
        centre, total = shared.value, None
        for row in _blocks(batches):
            own = make(centre, row)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "value"])

    return run


def added(held: DataFrame, centre, make: Callable[[Centre, dict], np.ndarray], size: int) -> np.ndarray:
    """The sum of make() over all blocks; shares are added on the executors, size numbers come to the driver."""
    out = np.zeros(size)
    for r in held.mapInArrow(_shares(centre, make), "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[r.i] = r.value
    return out


def products(v: np.ndarray, p: np.ndarray) -> Callable[[Centre, dict], np.ndarray]:
    """Of a block: ||Xv||², (XP)ᵀXv, XᵀXv, ||X||², end to end."""

    def make(centre: Centre, row: dict) -> np.ndarray:
        x = centre.rows(row)
        w = x @ v
        return np.concatenate(([w @ w], (x @ p).T @ w, x.T @ w, [np.square(x).sum()]))

    return make


def _off(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """r without what lies in the basis' span; twice, as once leaves rounding."""
    for _ in range(2):
        r = r - basis @ (basis.T @ r)
    return r


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray, float]], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(singular values, right singular vectors as columns, ||X||²) for the wanted largest, or all that were found.

    product(v, P) has ||Xv||², (XP)ᵀXv, XᵀXv and ||X||².
    """
    rng = np.random.default_rng(7)
    v, p, g = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))
    alphas, betas, whole = [], [], 0.0
    new = rng.standard_normal(width)
    new /= np.linalg.norm(new)
    while True:
        square, c, back, whole = product(new, p)
        scale = np.sqrt(whole)
        left = square - float(c @ c)
        alpha = np.sqrt(left) if left > 1e-13 * square and left > 1e-26 * whole else 0.0  # less is rounding
        own = 1 / alpha if alpha else 0.0
        v, p, g = np.column_stack((v, new)), np.column_stack((p, (new - p @ c) * own)), np.column_stack((g, (back - g @ c) * own))
        alphas.append(alpha)
        rest = _off(g[:, -1], v)
        beta = float(np.linalg.norm(rest))
        k = v.shape[1]
        b = np.diag(alphas) + np.diag(betas, 1)
        left_vectors, sigma, right = np.linalg.svd(b)
        if k == width:
            break
        if width > WHOLE and k > 2 * wanted and (beta * np.abs(left_vectors[-1, :wanted]) <= 4e-16 * sigma[0]).all():
            break
        if beta <= 1e-14 * scale:
            beta, rest = 0.0, _off(rng.standard_normal(width), v)
        betas.append(beta)
        new = _off(rest / np.linalg.norm(rest), v)
        new /= np.linalg.norm(new)
    return sigma, v @ right.T, whole


def _whitened(shared, columns: np.ndarray, explained: list[float], error: float):
    """Each row of each block, projected on the components."""

    def run(batches):
        centre = shared.value
        for row in _blocks(batches):
            w, deviation = centre.rows(row) @ columns, centre.deviations(row)
            n, k = w.shape
            each = lambda a, kind: pa.array(np.repeat(a, k), kind)
            ids = pa.array(row["ids"], pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            out = [ids, pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, centre.n), pa.int64()), each(deviation, pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fine() -> Column:
    """Whether a vector and all its entries are there and finite."""
    return F.col("embedding").isNotNull() & F.forall("embedding", lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) != float("inf")))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out. x is kept
    within 2^50 of shift. Vectors of several widths: missing entries count as zeros,
    empty vectors too. Components whose eigenvalue is zero (fewer distinct vectors
    than components, equal columns) have no rows. Deviations beyond the range of
    longs: the largest long. Null vec_id and repeated rows: rows as others. Empty
    table, or all vectors equal: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    some = vectors.where(fine()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = stored(some.mapInArrow(_pack(scale, shift), BLOCK_SQL), "vector-blocks")
    seen = {r.i: (int(r.s), r.n) for r in held.mapInArrow(_sums, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # a row a dimension
    n, width = seen.get(-1, (0, 0))[1], max(seen, default=-1) + 1
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not width:
        return spark.createDataFrame([], schema)
    centre = spark.sparkContext.broadcast(Centre(n, [seen[i][0] + shift * (n - seen[i][1]) for i in range(width)], shift))

    def product(v: np.ndarray, p: np.ndarray):
        out = added(held, centre, products(v, p), 2 + p.shape[1] + width)
        return out[0], out[1 : 1 + p.shape[1]], out[1 + p.shape[1] : -1], out[-1]

    sigma, right, whole = bidiagonalise(product, width, components)
    k = int((sigma[:components] ** 2 > RANK * sigma[0] ** 2).sum()) if sigma[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    columns = right[:, :k] / (sigma[:k] / np.sqrt(n))

    def second(centre: Centre, row: dict) -> np.ndarray:
        w = centre.rows(row) @ columns
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    out = added(held, centre, second, k + k * k) / n
    error = float(np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)).max())
    return held.mapInArrow(_whitened(centre, columns, (sigma[:k] ** 2 / whole).tolist(), error), schema)


def op12(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
