"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation.

Entries c become integers x = floor(1024 c) + 100000; the matrix A holds the
rows x - S / n (S: sums of the n rows), taken from exact integers n x - S.

1. v is a unit vector; each step makes u = A v - beta u' and then
   v = A'u - alpha v', orthogonalised against all earlier u and v, so A's
   projection is bidiagonal (alpha on, beta over the diagonal). A u is kept as
   the small vector w with u = A w: one pass over the rows gives A'(A w) and the
   products with all earlier u, and nothing as long as the table is stored.
2. The singular values and right vectors of the small bidiagonal matrix are
   those of A once their residuals vanish: components, and deviations
   sigma / sqrt(n).
3. Lanczos from one vector sees a repeated value once. Unless the steps span
   the whole space, further runs orthogonal to what was found look for values
   that were missed, until there is none above the least one kept.

A pass leaves a partial sum of each task, summed by Spark; the driver gets
vectors of one entry per dimension and one per step. Rows whose vector is null,
or holds null or non-finite entries (or any of 2^43 and more, whose x would not
be exact) are left out; so are rows whose length is not the commonest one (the
smaller of two). Repeated rows count each time. Null ids, equal values and
columns of any name pass through. Directions without spread (sigma under 1e-10
of the largest) are no components; an empty table has none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_arrow, materialize

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 43)
TIGHT, LOOSE, FLAT, BLOCK_ROWS = 1e-14, 1e-6, 1e-10, 4096


class Whitening(NamedTuple):
    n: int
    sums: list[int]           # of x, per dimension
    components: np.ndarray    # a unit eigenvector per row, by falling eigenvalue
    eigenvalues: np.ndarray   # of the covariance (divisor n)
    trace: float              # of the covariance
    identity_error: float     # of the whitened rows' covariance
    steps: int                # Lanczos steps


def integers(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x) of the usable vectors of a column of lists."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    c = col.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), dim)
    fine = (np.abs(c) < LARGEST).all(1)  # False for NaN
    return fits[fine], np.floor(SCALE * c[fine]).astype(np.int64) + SHIFT


def _summed(frame: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all tasks of the vector that ``make`` makes of each one's
    batches (long or double, ``size`` entries)."""
    kind = make(iter(())).dtype.kind
    name = "long" if kind == "i" else "double"

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([make(batches)], pa.list_(pa.int64() if kind == "i" else pa.float64()))],
                                         names=["part"])

    rows = (in_arrow(frame, run, f"part array<{name}>").select(F.posexplode("part").alias("i", "x"))
            .groupBy("i").agg(F.sum("x").alias("x")).collect())
    out = np.zeros(size, np.int64 if kind == "i" else np.float64)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in exact integers (Python's where 64 bits might not hold them)."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


class Rows:
    """The centred matrix, in blocks of integers in the shared folder."""

    def __init__(self, rows: DataFrame, vector: str, dim: int):
        def blocks(batches):
            for batch in batches:
                _, x = integers(batch.column(0), dim)
                parts = [x[i:i + BLOCK_ROWS].tobytes() for i in range(0, len(x), BLOCK_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["block"])

        self.dim = dim
        self.blocks = materialize(in_arrow(rows.select(vector), blocks, "block binary"))

        def totals(batches):
            out = np.zeros(dim + 1, np.int64)
            for x in self.read(batches):
                out += np.append(x.sum(0), len(x))
            return out

        *self.sums, self.n = _summed(self.blocks, totals, dim + 1).tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}

    def read(self, batches):
        for batch in batches:
            for raw in batch.column(0):
                yield np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, self.dim)

    def centred(self, batches):
        for x in self.read(batches):
            yield (_centred(x, self.n, self.sums) / self.n).astype(np.float64)

    def total(self, make, size: int) -> np.ndarray:
        """Sum of ``make(a)`` over all blocks a of the centred matrix."""
        def run(batches):
            out = np.zeros(size)
            for a in self.centred(batches):
                out += make(a)
            return out
        return _summed(self.blocks, run, size)

    def product(self, w: np.ndarray, before: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """For p = A w: p'p, the products of p with each A w' (w' of
        ``before``), and A'p."""
        all_w = np.array([w, *before]).T

        def run(a):
            p = a @ all_w
            return np.concatenate([p[:, 0] @ p, p[:, 0] @ a])

        out = self.total(run, all_w.shape[1] + self.dim)
        return float(out[0]), out[1:all_w.shape[1]], out[all_w.shape[1]:]


def _without(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """x orthogonal to a list of unit vectors (twice, for rounding)."""
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        x = x - b.T @ (b @ x)
    return x


def bidiagonalise(product, dim: int, want: int, size: float, away: list[np.ndarray], seed: int, tol: float):
    """Largest singular values and right vectors of A on the space orthogonal
    to ``away``: (values, vectors, steps). ``product`` as of ``Rows``; ``size``
    is A's Frobenius norm. Ends when ``want`` residuals are at most ``tol`` of the
    largest value, or the space is used up."""
    v = _without(np.random.default_rng(seed).normal(size=dim), away)
    vs, ws, back = [v / np.linalg.norm(v)], [], []
    diagonal, above = [], []
    while True:
        w = vs[-1] - (above[-1] * ws[-1] if above else 0)
        for _ in range(2):
            norm, on, image = product(w, ws)
            if ws:
                w, image = w - np.array(ws).T @ on, image - np.array(back).T @ on
            left = norm - on @ on
            if left > norm / 2:  # little was taken off: what is left is orthogonal
                break
        alpha = np.sqrt(max(left, 0.0))
        used_up = alpha <= 1e-13 * size
        if not used_up:
            ws.append(w / alpha)
            back.append(image / alpha)
            diagonal.append(alpha)
            rest = _without(back[-1] - alpha * vs[-1], [*away, *vs])
            beta = float(np.linalg.norm(rest))
            used_up = beta <= 1e-13 * size or len(vs) + len(away) == dim
        # A V = U B, a row less than columns if the last A v was nothing new
        b = np.diag(diagonal) + np.diag(above[:max(0, len(diagonal) - 1)], 1) if diagonal else np.zeros((0, 0))
        if len(vs) > len(diagonal):
            b = np.column_stack([b, [*[0.0] * (len(diagonal) - 1), above[-1]]]) if diagonal else b.reshape(0, 1)
        if not diagonal:
            return np.zeros(0), np.zeros((0, dim)), len(vs)
        left_of, values, right = np.linalg.svd(b)
        values = values[:len(diagonal)]
        some = min(want, len(values))
        if used_up or len(values) >= want and (beta * np.abs(left_of[-1, :some]) <= tol * values[0]).all():
            return values[:some], right[:some] @ np.array(vs), len(vs)
        vs.append(rest / beta)
        above.append(beta)


def leading(product, dim: int, want: int, size: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``want`` largest singular values of A with right vectors, repeated
    values as often as they occur."""
    if size == 0:
        return np.zeros(0), np.zeros((0, dim)), 0
    values, vectors, steps = bidiagonalise(product, dim, want, size, [], seed, TIGHT)
    whole = steps == dim
    while not whole and 0 < len(vectors) < dim:
        seed += 1
        full = len(values) == want
        found, extra, more = bidiagonalise(product, dim, 1, size, list(vectors), seed, LOOSE if full else TIGHT)
        steps += more
        if not len(found) or found[0] <= (values[-1] * (1 + 1e-9) if full else FLAT * values[0]):
            break
        if full:  # a value was missed
            found, extra, more = bidiagonalise(product, dim, 1, size, list(vectors), seed, TIGHT)
            steps += more
        order = np.argsort(-np.append(values, found), kind="stable")[:want]
        values, vectors = np.append(values, found)[order], np.vstack([vectors, extra])[order]
    keep = values > FLAT * values[0] if len(values) else np.zeros(0, bool)
    return values[keep], vectors[keep], steps


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8, seed: int = 1) -> Whitening:
    """Whitening of the vectors of ``rows`` onto the leading components."""
    entry = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST)  # noqa: E731  NaN counts as large
    common = (rows.where(F.forall(vector, entry)).groupBy(F.size(vector).alias("dim")).count()
              .orderBy(F.desc("count"), "dim").first())
    if not common or not common["dim"]:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    a = Rows(rows, vector, common["dim"])
    squares = float(a.total(lambda x: np.array([(x * x).sum()]), 1)[0])
    values, vectors, steps = leading(a.product, a.dim, min(components, a.dim), np.sqrt(squares), seed)
    to = (vectors / (values / np.sqrt(a.n))[:, None]).T if len(values) else np.zeros((a.dim, 0))
    k, mean, error = len(values), 0.0, 0.0
    if k:
        mean = a.total(lambda x: (x @ to).sum(0), k) / a.n
        cov = a.total(lambda x: ((z := x @ to - mean).T @ z).ravel(), k * k).reshape(k, k) / a.n
        error = float(np.abs(cov - np.eye(k)).max())
    return Whitening(a.n, a.sums, vectors, values ** 2 / a.n, squares / a.n, error, steps)


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """``rows`` with two new last columns, ``whitened`` (array<double>, an entry
    per component) and ``deviation`` (decimal, the exact sum of (n x - S)^2);
    both null where the vector is left out."""
    names = [fresh(rows, "whitened"), fresh(rows, "deviation")]
    columns, at, dim = [*rows.columns, *names], rows.columns.index(vector), len(model.sums)
    to = model.components.T / np.sqrt(model.eigenvalues)

    def run(batches):
        for batch in batches:
            places, x = integers(batch.column(at), dim) if model.n else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
            t = _centred(x, model.n, model.sums)
            z = (t / max(model.n, 1)).astype(np.float64) @ to if len(places) else np.zeros((0, to.shape[1]))
            wide = dim * (int(np.abs(t).max(initial=0)) + 1) ** 2 >= 1 << 63
            squares = pa.array(((t.astype(object) if wide else t) ** 2).sum(1).tolist() if len(places) else [], pa.decimal128(38, 0))
            ends = np.arange(len(places) + 1, dtype=np.int32) * z.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))
            back = np.full(batch.num_rows, -1)
            back[places] = np.arange(len(places))
            back = pa.array(back, mask=back < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.take(back), squares.take(back)], names=columns)

    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType())),
                           T.StructField(names[1], T.DecimalType(38, 0))])
    return in_arrow(rows, run, schema)
