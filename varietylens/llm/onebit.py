"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes.

Unit vectors are taken from their mean c and rotated at random into at least
``BITS`` dimensions; the signs are a vector's code. Stored with it: the distance
r from c, the cosine x of code and vector, and the product with c.

    <o, q> = <o - c, q - c> + <o, c> + <q, c> - <c, c>

The first term is estimated by r <code, q - c> / x; its error is, as the
rotation is random, normal with deviation r |q - c| sqrt(1 / x^2 - 1) / sqrt(bits - 1)
at most. ``bound`` deviations either way are the error bound.

1. Equal vectors are one class, which keeps its ``k`` + 1 smallest ids.
2. A grid deals classes and queries: each of G query groups (bounded in bytes)
   meets each of C slabs of the classes. The codes of a slab stream past the
   queries in blocks; a class whose upper bound reaches a query's k-th best
   cosine so far is reranked by the exact one. So a task holds a group of queries
   and a block, and puts out k classes per query however many are close.
3. The best of all slabs and the query's own class give the k nearest rows.

Every row is indexed and every code is estimated against every query. Vectors
that are null, empty, zero or hold null or non-finite components take no part;
vectors meet only vectors of their own length. Repeated rows are rows of their
own (a query leaves out one row of its id and vector, its own); null ids are
never queries and come last among ties. Columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, partitions

BITS, BOUND, SLAB_ROWS, QUERY_BYTES, CELLS, PAIRS = 256, 3.0, 1 << 16, 16 << 20, 8 << 20, 1 << 17
_INDEX = "cid long, dim int, key binary, code binary, r double, x double, oc double, own double, first long"


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim, orthonormal columns: a random rotation of vectors that zeros
    make ``bits`` long."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).normal(size=(bits, dim)))
    return q * np.sign(np.diag(r))


def bits_of(dim: int, least: int) -> int:
    return max(least, -(-dim // 8) * 8)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps
    squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / norm[:, None], norm


def _keys(batches):
    """(id, query, dim, key): usable vectors as little-endian doubles."""
    for batch in batches:
        col = batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            v = col.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.isfinite(v).all(1) & v.any(1)
            at, v = pa.array(at[fine]), np.ascontiguousarray(v[fine], "<f8")
            keys = pa.array([r.tobytes() for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at),
                                              pa.array(np.full(len(at), dim, np.int32)), keys], names=["id", "query", "dim", "key"])


def _lengths(dims: np.ndarray):
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _vectors(keys: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<f8").reshape(-1, dim)


def centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """Mean unit vector of the classes of each length."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at in _lengths(batch.column(0).to_numpy()):
                u, _ = unit(scaled(_vectors(batch.column(1).take(pa.array(at)), dim)))
                sums[dim] = sums.get(dim, 0) + np.append(u.sum(0), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                         names=["dim", "part"])

    # the dimensions of each length that occurs, not the rows
    sums: dict[int, np.ndarray] = {}
    for r in (in_arrow(classes.select("dim", "key"), run, "dim int, part array<double>")
              .select("dim", F.posexplode("part").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x")).collect()):
        sums.setdefault(r["dim"], np.zeros(r["dim"] + 1))[r["i"]] = r["x"]
    return {d: s[:-1] / s[-1] for d, s in sums.items()}


def encode(o: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """(codes, r, x, oc) of unit vectors: packed signs and correction scalars."""
    away, oc = o - centre, o @ centre
    r = np.sqrt(np.einsum("ij,ij->i", away, away))
    turned = away @ turn.T
    signs = turned >= 0
    x = np.abs(turned).sum(1) / np.sqrt(len(turn)) / np.where(r > 0, r, 1)
    return np.packbits(signs, axis=1), r, np.where(r > 0, x, 1.0), oc


class Queries:
    """A group of queries in a task, and their k best classes so far."""

    def __init__(self, cid: np.ndarray, v: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, bound: float):
        self.cid, self.k, self.bound, self.bits = cid, k, bound, len(turn)
        self.v = scaled(v)
        u, self.norm = unit(self.v)
        away = u - centre
        self.turned = (away @ turn.T / np.sqrt(self.bits)).astype(np.float32)
        self.away = np.sqrt(np.einsum("ij,ij->i", away, away))
        self.qc = u @ centre - centre @ centre
        n = len(cid)
        self.score, self.first = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.full((n, k), -1)

    def _rerank(self, q: np.ndarray, c: np.ndarray, cid, first, v, norm) -> None:
        """Exact cosines of the pairs (q, c), kept if among the k best."""
        exact = np.einsum("ij,ij->i", self.v[q], v[c]) / (self.norm[q] * norm[c])
        rows = np.unique(q)
        every = np.concatenate([np.repeat(rows, self.k), q])
        score = np.concatenate([self.score[rows].ravel(), exact])
        tie = np.concatenate([self.first[rows].ravel(), first[c]])
        found = np.concatenate([self.found[rows].ravel(), cid[c]])
        order = np.lexsort((tie, -score, every))
        at = order[np.searchsorted(every[order], rows)[:, None] + np.arange(self.k)]  # k old ones at least
        self.score[rows], self.first[rows], self.found[rows] = score[at], tie[at], found[at]

    def pass_by(self, cid, first, code, r, x, oc, v) -> None:
        """A block of classes: estimate all, rerank what the bound leaves."""
        signs = np.unpackbits(code, axis=1, count=self.bits).astype(np.float32) * 2 - 1
        near = (self.turned @ signs.T) * (r / x) + oc + self.qc[:, None]
        near[self.cid[:, None] == cid] = -np.inf
        upper = near + self.away[:, None] * (self.bound / np.sqrt(max(self.bits - 1, 1)) * r * np.sqrt(np.maximum(0, 1 / x ** 2 - 1)))
        upper += 1e-6  # single precision
        v = scaled(v)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        args = (cid, first, v, norm)
        best = np.argpartition(-near, min(self.k, len(cid)) - 1, axis=1)[:, :self.k]  # a first threshold
        q = np.repeat(np.arange(len(self.cid)), best.shape[1])
        self._some(q, best.ravel(), upper, args)
        upper[q, best.ravel()] = -np.inf
        for at in range(0, len(self.cid), step := max(1, PAIRS // len(cid))):
            q, c = np.nonzero(upper[at:at + step] >= self.score[at:at + step, -1:])
            self._some(q + at, c, upper, args)

    def _some(self, q, c, upper, args) -> None:
        keep = (upper[q, c] >= self.score[q, -1]) & (upper[q, c] > -np.inf)
        if keep.any():
            self._rerank(q[keep], c[keep], *args)


def index(rows: DataFrame, query: Column, vec_id: str, vector: str, k: int, bits: int, seed: int):
    """(classes with codes, ids of each class, query rows, centres)."""
    flat = rows.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    flat = materialize(in_arrow(flat, _keys, "id long, query boolean, dim int, key binary"), "zstd")
    order = Window.partitionBy("dim", "key").orderBy(F.col("id").asc_nulls_last())
    few = (flat.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("dim", "key")
               .agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"),
                    F.min("id").alias("first")))
    classes = materialize(few.withColumn("cid", F.monotonically_increasing_id()), "zstd")
    middle = centres(classes)

    def run(batches):
        turns = {}
        for batch in batches:
            for dim, at in _lengths(batch.column(1).to_numpy()):
                turn = turns.setdefault(dim, rotation(dim, bits_of(dim, bits), seed)) if dim not in turns else turns[dim]
                part = batch.take(pa.array(at))
                v = scaled(_vectors(part.column(2), dim))
                o, norm = unit(v)
                codes, r, x, oc = encode(o, middle[dim], turn)
                own = np.einsum("ij,ij->i", v, v) / (norm * norm)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (r, x, oc, own)),
                     part.column(3)], names=[f.split()[0] for f in _INDEX.split(", ")])

    coded = materialize(in_arrow(classes.select("cid", "dim", "key", "first"), run, _INDEX), "zstd")
    asked = flat.where("query and id is not null").select(F.col("id").alias("query_id"), F.col("dim").alias("a_dim"), F.col("key").alias("a_key"))
    asked = asked.join(classes.select("cid", "dim", "key"), (F.col("a_dim") == F.col("dim")) & (F.col("a_key") == F.col("key")))
    return coded, classes.select("cid", "ids"), materialize(asked.select("query_id", F.col("cid").alias("q_cid"))), middle


def search(rows: DataFrame, query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, bits: int = BITS,
           bound: float = BOUND, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every row
    that meets ``query``."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    coded, ids, asked, middle = index(rows, query, vec_id, vector, k, bits, seed)
    asking = asked.select("q_cid").distinct()
    # a row per length that occurs
    sizes = (coded.join(asking, coded["cid"] == asking["q_cid"], "left").groupBy("dim")
                  .agg(F.count("*").alias("n"), F.count("q_cid").alias("queries")).collect())
    grid, cells = [], 0
    for s in sizes:
        groups = max(1, -(-s["queries"] * 8 * (s["dim"] + bits_of(s["dim"], bits)) // QUERY_BYTES))
        slabs = max(-(-s["n"] // SLAB_ROWS), min(-(-2 * n // groups), -(-s["n"] // 256)), 1)
        grid.append((s["dim"], groups, slabs, cells))
        cells += groups * slabs
    grid = F.broadcast(spark.createDataFrame(grid, "g_dim int, groups int, slabs int, cells long"))
    dealt = coded.join(grid, F.col("dim") == F.col("g_dim"))
    whose, where = (F.pmod(F.xxhash64("cid", F.lit(i)), F.col(c)).cast("int") for i, c in ((1, "groups"), (2, "slabs")))
    columns = [c.split()[0] for c in _INDEX.split(", ") if not c.startswith("own")]
    cell = lambda g, s: (F.col("cells") + g * F.col("slabs") + s).cast("long").alias("cell")
    guests = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
        cell(F.col("g"), where), F.lit(True).alias("guest"), *columns)
    hosts = (dealt.join(asking, F.col("cid") == F.col("q_cid"), "left_semi")
                  .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
                  .select(cell(whose, F.col("s")), F.lit(False).alias("guest"), *columns))

    def meet(batches):
        cell, own, waiting, turns = None, None, [], {}

        def out():
            if own is None:
                return
            q, c = np.nonzero(own.found >= 0)
            for at in range(0, len(q), PAIRS):
                a, b = q[at:at + PAIRS], c[at:at + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(own.cid[a]), pa.array(own.found[a, b]), pa.array(own.first[a, b]),
                                                  pa.array(own.score[a, b])], names=["q_cid", "cid", "first", "score"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if keys[lo] != cell:
                    yield from out()
                    cell, own, waiting = keys[lo], None, []
                part = batch.slice(lo, hi - lo)
                dim = part.column(3)[0].as_py()
                guest = part.column(1).to_numpy(zero_copy_only=False)
                hosts = int((~guest).sum())
                if hosts:
                    waiting.append((part.column(2)[:hosts].to_numpy(), _vectors(part.column(4)[:hosts], dim)))
                part = part.slice(hosts)
                if not part.num_rows or own is None and not waiting:
                    continue
                if own is None:
                    if dim not in turns:
                        turns[dim] = rotation(dim, bits_of(dim, bits), seed)
                    own = Queries(*(np.concatenate(x) for x in zip(*waiting, strict=True)), middle[dim], turns[dim], k, bound)
                step = max(64, min(4096, CELLS // len(own.cid)))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    code = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8).reshape(some.num_rows, -1)
                    first = pc.fill_null(some.column(9), np.iinfo(np.int64).max).to_numpy()
                    own.pass_by(some.column(2).to_numpy(), first, code, *(some.column(i).to_numpy() for i in (6, 7, 8)),
                                _vectors(some.column(4), dim))
        yield from out()

    met = in_arrow(hosts.union(guests).repartition(n, "cell").sortWithinPartitions("cell", "guest"), meet,
                   "q_cid long, cid long, first long, score double")
    best = Window.partitionBy("q_cid").orderBy(F.desc("score"), "first")
    best = materialize(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n", "first"))
    own = coded.join(asking, F.col("cid") == F.col("q_cid")).select("q_cid", "cid", F.col("own").alias("score"))
    # at most (k + 1)^2 rows per distinct query vector
    near = (best.select("q_cid", "cid", "score").union(own).join(ids, "cid")
                .select("q_cid", F.explode("ids").alias("i"), (-F.col("score")).alias("down"), (F.col("cid") == F.col("q_cid")).alias("own"))
                .groupBy("q_cid").agg(F.array_sort(F.collect_list(F.struct("down", "i.none", "i.id", "own"))).alias("near")))
    mine = F.array_position(F.transform("near", lambda e: e["own"] & e["id"].eqNullSafe(F.col("query_id"))), True)
    got = (asked.join(near, "q_cid").withColumn("mine", mine)
                .withColumn("near", F.filter("near", lambda e, i: i + 1 != F.col("mine")))
                .select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "e")))
    return got.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.down")).alias("score"))
