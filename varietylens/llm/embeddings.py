"""Exact near-duplicate search over embeddings: a metric range join.

Unit vectors are points of a metric space, a cosine bound is a distance
bound r = sqrt(2 - 2 cos). Pivots partition each label's vectors: a vector's
home cell is that of its nearest pivot. For a pair within r, the triangle
inequality gives d(x, q) <= R + r for the home cell of the other vector
(pivot q, radius R) and d(x, q) <= d(x, p) + 2r for x's own pivot p; a vector
that meets both is copied to q's cell. Copies go to lower cells only, so each
pair meets once, and every cell joins on its own. Cells are dealt in blocks of
home rows, so a task holds one block; the other rows stream past it.

Equal vectors of a label are one class, joined once. Vectors that are null,
empty, zero or hold null or non-finite components, and vectors without label,
link with nothing; vectors of different length never link. Repeated rows are
vectors of their own. Null ids count as links but never name a component
unless all its ids are null.

On isotropic data in many dimensions no metric partition prunes much: the
join then does the work of a blocked nested loop, within labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_arrow, materialize, partitions, runs

COSINE, CELL_ROWS, MAX_PIVOTS = 0.93, 2000, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def usable(vector: str, label: str) -> tuple[F.Column, F.Column]:
    """The vector as doubles, and whether a row can link: a label, and a vector
    without null or non-finite components that is not empty or zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return v, F.col(label).isNotNull() & F.coalesce(fine & some, F.lit(False))


def classes(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(space, cid, l, vector, n, first_id): distinct valid vectors of a space,
    which is a label and a length. Numbers (cid) hold once this is written."""
    v, ok = usable(vector, label)
    return (rows.where(ok).select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"), F.col(label).alias("l"))
                .groupBy("l", "vector").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
                .select(F.xxhash64("l", F.size("vector")).alias("space"), F.monotonically_increasing_id().alias("cid"),
                        "l", "vector", "n", "first_id"))


def pick_pivots(known: DataFrame, cell_rows: int, most: int) -> dict[int, np.ndarray]:
    """Pivots per space, at most ``most`` in all; spaces of up to
    ``cell_rows`` classes are one cell and need none."""
    from pyspark.sql import Window
    sizes = (known.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
                  .orderBy(F.desc("n"), "space").limit(most).collect())
    if not sizes:
        return {}
    total = sum(s["n"] for s in sizes)
    want = {s["space"]: max(1, min(-(-s["n"] // cell_rows), most * s["n"] // total)) for s in sizes}
    spark = known.sparkSession
    quota = spark.createDataFrame([(s["space"], want[s["space"]], s["n"]) for s in sizes], "space long, want long, in_space long")
    # candidates by hash, a few times as many as wanted, so the rank below is over few rows
    h = F.pmod(F.xxhash64("cid"), F.lit(1 << 30))
    near = (known.join(F.broadcast(quota), "space").where(h * F.col("in_space") < (F.col("want") * 4 + 64) * (1 << 30))
                 .withColumn("r", F.row_number().over(Window.partitionBy("space").orderBy(h, "cid")))
                 .where(F.col("r") <= F.col("want")).select("space", "vector", "r").orderBy("space", "r").collect())
    found: dict[int, list] = {}
    for r in near:
        found.setdefault(r["space"], []).append(r["vector"])
    return {s: _unit(np.array(v, np.float64)) for s, v in found.items()}


def _spaces(space: np.ndarray):
    order = np.argsort(space, kind="stable")
    cuts = np.flatnonzero(np.diff(space[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(space[rows[0]]), rows


def _spanning(hit: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges with the same components as the pairs marked in ``hit``."""
    out, rows = [], np.flatnonzero(hit.any(1))
    free_rows, free_cols = np.zeros(len(row_ids), bool), np.ones(len(col_ids), bool)
    free_rows[rows] = True
    for first in rows:
        if not free_rows[first]:
            continue
        free_rows[first] = False
        front, members = np.array([first]), [row_ids[first:first + 1]]
        while len(front):
            cols = np.flatnonzero(hit[front].any(0) & free_cols)
            free_cols[cols] = False
            members.append(col_ids[cols])
            front = np.flatnonzero(hit[:, cols].any(1) & free_rows) if len(cols) else front[:0]
            free_rows[front] = False
            members.append(row_ids[front])
        ids = np.concatenate(members)
        out.append((ids, np.full(len(ids), ids.min())))
    return out


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows``."""
    spark = rows.sparkSession
    known = materialize(classes(rows, vec_id, vector, label))
    pivots = spark.sparkContext.broadcast(pick_pivots(known, cell_rows, max_pivots))
    r = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def home(batches):
        for batch in batches:
            space = batch.column(0).to_numpy()
            cell, far = np.zeros(len(space), np.int32), np.full(len(space), 2.0)
            for s, at in _spaces(space):
                if s in pivots.value:
                    d = _distance(_unit(_matrix(batch.column(1).take(pa.array(at)))), pivots.value[s])
                    cell[at] = d.argmin(1)
                    far[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(far)],
                                             names=["space", "cell", "far"])

    # one row per cell: at most max_pivots, and one per space without pivots, which stays out
    cells = (in_arrow(known.select("space", "vector"), home, "space long, cell int, far double")
                  .groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")))
    many = cells.where(F.col("n") > cell_rows).select("space", "cell", "n", "far")
    withp = sorted(pivots.value)
    table = {(c["space"], c["cell"]): (-(-c["n"] // cell_rows), c["far"]) for c in
             (cells.where(F.col("space").isin(withp)) if withp else many).unionByName(many).distinct().collect()}
    table = spark.sparkContext.broadcast(table)

    def deal(batches):
        for batch in batches:
            space, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys: list[np.ndarray] = []
            source, inner = [], []
            for s, at in _spaces(space):
                p = pivots.value.get(s)
                d = None if p is None else _distance(_unit(_matrix(batch.column(2).take(pa.array(at)))), p)
                own = np.zeros(len(at), np.int64) if d is None else d.argmin(1)
                for c in np.unique(own):
                    here = at[own == c]
                    blocks, _ = table.value.get((s, int(c)), (1, 2.0))
                    block = (cid[here].view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                    for b in range(blocks):  # home in its own block, a guest of the lower ones
                        guests = here[block >= b]
                        keys.append(np.full(len(guests), _key(s, int(c), b)))
                        source.append(guests)
                        inner.append(block[block >= b] == b)
                if d is not None:
                    least = d.min(1)
                    for c in range(len(p)):
                        blocks, far = table.value.get((s, c), (0, 0.0))
                        if not blocks:
                            continue
                        guests = at[(own > c) & (d[:, c] <= far + r) & (d[:, c] <= least + 2 * r)]
                        for b in range(blocks):
                            keys.append(np.full(len(guests), _key(s, c, b)))
                            source.append(guests)
                            inner.append(np.zeros(len(guests), bool))
            take = pa.array(np.concatenate(source)) if source else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)),
                 pa.array(~np.concatenate(inner) if inner else np.zeros(0, bool)),
                 batch.column(1).take(take), batch.column(3).take(take), batch.column(2).take(take)],
                names=["cell", "guest", "cid", "n", "vector"])

    def join(batches):
        cell, own = None, []
        for batch in batches:
            ends = np.append(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1, batch.num_rows)
            out = []
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                for at in range(lo, hi, 4096):
                    part = batch.slice(at, min(4096, hi - at))
                    key, guest = part.column(0)[0].as_py(), part.column(1).to_numpy(zero_copy_only=False)
                    ids, n = part.column(2).to_numpy(), part.column(3).to_numpy()
                    x = _unit(_matrix(part.column(4)))
                    if key != cell:
                        cell, own = key, []
                    for mine, m, y in own:  # home rows that came before
                        _meet(out, x, ids, n, y, mine, m, cosine)
                    home = np.flatnonzero(~guest)
                    if len(home):
                        _meet_inside(out, x[home], ids[home], n[home], cosine)
                        if len(home) < len(ids):
                            g = np.flatnonzero(guest)
                            _meet(out, x[g], ids[g], n[g], x[home], ids[home], n[home], cosine)
                        own.append((ids[home], n[home], x[home]))
            a, links, root = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in
                              ([o[i] for o in out] for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(links), pa.array(root)],
                                             names=["cid", "links", "root"])

    dealt = in_arrow(known.select("space", "cid", "vector", "n"), deal, "cell long, guest boolean, cid long, n long, vector array<double>")
    found = materialize(in_arrow(dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "guest"), join, "cid long, links long, root long"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member = (known.select("cid", "n", "first_id").join(links, "cid", "left")
                   .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                   .select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("root", "cid").alias("root"), "first_id"))
    heads = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(heads, "root").select("cid", "n_links", "component_id")
    member = materialize(known.select("cid", F.col("l").alias("m_l"), F.col("vector").alias("m_v")).join(member, "cid")
                              .withColumnRenamed("cid", "m_cid"))
    v, ok = usable(vector, label)  # a row that cannot link has no key
    ids = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(ok, F.col(label)).alias("l"), F.when(ok, v).alias("v"))
    out = ids.join(member, (F.col("l") == F.col("m_l")) & (F.col("v") == F.col("m_v")), "left")
    head = F.when(F.col("m_cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      head.alias("component_id"), F.col("vec_id").eqNullSafe(head).alias("kept"))


def _key(space: int, cell: int, block: int) -> int:
    from xxhash import xxh64_intdigest
    return int(np.uint64(xxh64_intdigest(f"{space}/{cell}/{block}")).astype(np.int64))


def _add(out: list, ids: np.ndarray, links: np.ndarray) -> None:
    some = links > 0
    out.append((ids[some], links[some].astype(np.int64), ids[some]))


def _meet(out, x, x_ids, x_n, y, y_ids, y_n, cosine) -> None:
    """Links between two different sets of classes."""
    hit = x @ y.T >= cosine
    if hit.any():
        _add(out, x_ids, hit @ y_n)
        _add(out, y_ids, x_n @ hit)
        out += [(a, np.zeros(len(a), np.int64), b) for a, b in _spanning(hit, x_ids, y_ids)]


def _meet_inside(out, x, ids, n, cosine) -> None:
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    if hit.any():
        _add(out, ids, hit @ n)
        out += [(a, np.zeros(len(a), np.int64), b) for a, b in _spanning(hit, ids, ids)]
