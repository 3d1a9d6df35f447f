"""Whitening of embeddings by shifted CholeskyQR.

Centred rows Z are orthogonalised by passes over all vectors: tasks solve a triangular system for their rows and add up a Gram matrix, the driver
factors the sum (dimensions x dimensions, whatever the rows). The composed factor R has Z = Q R, and an SVD of R gives the components. A shift keeps the first
factorisation definite when Z is badly conditioned; two more passes take it out again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows, settled

SCALE, OFFSET = 64, 1_000_000  # fixed values: x = floor(SCALE * entry) + OFFSET
LARGEST = float(2**40)  # entries beyond have no place among the longs that sums and squares are made of
RANK = 1e-12  # a column whose rest is a smaller share of the largest column hangs on the others
UNIT = np.finfo(np.float64).eps / 2


def finite_vectors(df: DataFrame, vector: str, dims: int | None = None) -> tuple[DataFrame, int, str]:
    """The rows whose vector can be whitened, the number of dimensions, and the column added for its long entries x.

    Vectors that are null, empty, or hold a null, non-finite or larger-than-LARGEST entry are dropped. Without `dims` the commonest length
    holds (the longer of two), and vectors of another length are dropped too.
    """
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))  # not so for NaN: it is above all
    rows = df.filter(ok & (F.size(vector) > 0))
    if dims is None:
        common = rows.groupBy(F.size(vector).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
        dims = common["d"] if common else 0
    x = fresh(df, "_x")
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return rows.filter(F.size(vector) == dims).withColumn(x, entries), dims, x


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Sums:
    """n and the exact sums of the fit list; how its rows are centred."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that holds them, Python's integers where not."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)) >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, dtype=object) if wide else x * self.n - np.array(self.sums, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squared(self, x: np.ndarray) -> pa.Array:
        d = self.deviations(x)
        if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
            return pa.array([sum(int(v) ** 2 for v in row) for row in d], pa.int64())
        return pa.array((d * d).sum(axis=1), pa.int64())


def totals(fit: DataFrame, x: str, dims: int) -> Sums:
    """Counted and summed in the tasks, then over them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=object)
        for b in batches:
            m = matrix_of(b.column(0), dims)
            n, sums = n + len(m), sums + m.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": range(dims + 1), "v": [n, *map(int, sums)]}, pa.schema([("k", pa.int32()), ("v", pa.int64())]))

    found = fit.select(x).mapInArrow(part, "k int, v bigint").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    values = {r["k"]: int(r["v"]) for r in found.collect()}  # dims + 1 numbers
    return Sums(values.get(0, 0), [values.get(i + 1, 0) for i in range(dims)])


def product(fit: DataFrame, x: str, dims: int, sides: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all rows of A'B, where `sides` makes A and B of a block of x: each task sums its blocks, Spark sums the tasks' entries."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                left, right = sides(matrix_of(b.column(0), dims))
                total = left.T @ right if total is None else total + left.T @ right
        if total is not None:
            i, j = np.indices(total.shape, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    found = fit.select(x).mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # dims x dims
    i, j, v = (found.column(c).to_numpy() for c in "ijv")
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = v
    return out


def independent(gram: np.ndarray) -> np.ndarray:
    """Columns that span the others, by pivoted Cholesky: the one with the largest rest is next, until the rest is rounding."""
    rest, chosen = gram.copy(), []
    least = RANK * max(gram.diagonal().max(initial=0.0), 0.0)
    while len(chosen) < len(gram):
        p = int(np.argmax(rest.diagonal()))
        if rest[p, p] <= least:
            break
        chosen.append(p)
        c = rest[:, p] / np.sqrt(rest[p, p])
        rest = rest - np.outer(c, c)
        rest[chosen, :] = rest[:, chosen] = 0.0
    return np.sort(np.array(chosen, dtype=np.int64))


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows · R1⁻¹ · R2⁻¹ ...: one triangular solve for each upper factor, column by column over all rows of the block."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


class Whitening:
    """What the passes found: components as columns (eigenvectors of the covariance, largest first), eigenvalues, their trace, and the rows' sums."""

    def __init__(self, sums: Sums, components: np.ndarray, values: np.ndarray, trace: float, identity_error: float):
        self.sums, self.components, self.values, self.trace, self.identity_error = sums, components, values, trace, identity_error

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ self.components / np.sqrt(self.values)


def fit_whitening(vectors: DataFrame, x: str, dims: int, most: int = 16) -> Whitening | None:
    """Fits on each distinct vector once (None where there is no vector); at most `most` components, and none along which nothing varies.

    The distinct vectors are written to the shared folder. Six passes read them: sums, Gram matrices of the rows and of two orthogonalisations, and the
    covariance of the whitened rows (one more where dimensions hang on each other). The driver sees dims² numbers a pass.
    """
    fit = settled(vectors.select(x).distinct(), "distinct-vectors")
    sums = totals(fit, x, dims)
    if sums.n == 0:
        return None
    gram = product(fit, x, dims, lambda m: (sums.centred(m),) * 2)
    keep = independent(gram)
    trace = float(gram.trace()) / sums.n
    if not len(keep):
        return Whitening(sums, np.zeros((dims, 0)), np.zeros(0), trace, 0.0)
    inner, r = gram[np.ix_(keep, keep)], len(keep)
    shift = 11 * (sums.n * r + r * (r + 1)) * UNIT * np.linalg.norm(inner, 2)
    factors = [np.linalg.cholesky(inner + shift * np.eye(r)).T]
    for _ in range(2):
        inner = product(fit, x, dims, lambda m: (solved(sums.centred(m)[:, keep], factors),) * 2)
        factors.append(np.linalg.cholesky(inner).T)
    if r == dims:
        composed = factors[2] @ factors[1] @ factors[0]
    else:  # the other columns' coordinates in the orthonormal rows
        composed = product(fit, x, dims, lambda m: (solved((z := sums.centred(m))[:, keep], factors), z))
    _, sigma, turned = np.linalg.svd(composed, full_matrices=False)
    components = turned[:most].T
    components = components * np.where(np.take_along_axis(components, np.abs(components).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    found = Whitening(sums, components, sigma[:most] ** 2 / sums.n, trace, 0.0)

    def centred_twice(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.hstack([found.apply(m), np.ones((len(m), 1))])
        return w, w

    both = product(fit, x, dims, centred_twice) / sums.n
    mean = both[:-1, -1]
    found.identity_error = float(np.abs(both[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return found


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 16, dims: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row with a sound vector, one row a component.

    n is the number of distinct vectors, `deviation` the exact sum over dimensions of (n·x − S)², `whitened` the centred vector along the component over
    its standard deviation, `explained` the component's share of the variance. Components are numbered from 1 by falling variance, signed so that
    their largest entry is positive. Rows without a sound vector are dropped (see finite_vectors); repeated rows and null ids are answered like others. Where all vectors are equal
    nothing varies and no rows come; fewer components come than `most` where the vectors span fewer dimensions. An empty table gives no rows.
    """
    rows, dims, x = finite_vectors(df, vector, dims)
    kind = dict(df.dtypes)[vec_id]
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_whitening(rows, x, dims, most) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], shape)
    k = len(model.values)

    def answer(piece: pa.RecordBatch) -> pa.Table:
        m = matrix_of(piece.column(1), dims)
        each = pa.array(np.repeat(np.arange(len(m)), k))
        return pa.table({
            "vec_id": piece.column(0).take(each),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)),
            "n": np.full(len(m) * k, model.sums.n),
            "deviation": model.sums.squared(m).take(each),
            "whitened": model.apply(m).ravel(),
            "explained": np.tile(model.values / model.trace, len(m)),
            "identity_error": np.full(len(m) * k, model.identity_error),
        })

    if not k:
        return df.sparkSession.createDataFrame([], shape)
    return map_rows(rows.select(F.col(vec_id).alias("vec_id"), x), answer, shape)
