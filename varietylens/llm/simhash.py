"""SimHash near-duplicate detection with pivot distance tables.

A text's fingerprint takes, bit by bit, the majority over the XXH64 hashes of
its word shingles. Distinct fingerprints get a table of Hamming distances to
``PIVOTS`` reference fingerprints, kept per block of bits. By the triangle
inequality two fingerprints at distance d differ by at most d in every
coordinate, and within a block no coordinate differs unless a bit of that
block does. With ``max_bits + 2`` blocks, a pair within ``max_bits`` bits
leaves two blocks untouched: it agrees in the whole table rows of some two
blocks. So the table rows of two blocks are the (exact) join key; pairs that
meet are discarded by their largest coordinate difference, and survivors are
verified by their Hamming distance.

Null and empty texts have fingerprint zero, linked like any other; null ids
take part and are never a component's id unless all its ids are null (then
null). Repeated rows share fingerprint and component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, in_arrow, materialize, mix64, partitions, runs

SEED, PIVOTS = 42, 16
U64 = np.uint64


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, ASCII space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashed = xxhash.xxh64_intdigest
    count, votes = 0, np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded pieces of very long texts
        part = words[at:at + 65536 + width - 1]
        shingles = zip(*(part[i:] for i in range(width)), strict=False) if n > 1 or len(words) >= width else [words]
        h = np.fromiter((hashed(b" ".join(s), SEED) for s in shingles), U64)
        count += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.col(text).alias("text"))
    return in_arrow(rows, run, "doc_id long, text_hash long, fp long")


class PivotTable:
    """Reference fingerprints and the distances to them, per block of bits."""

    def __init__(self, max_bits: int):
        self.max_bits, blocks = max_bits, max_bits + 2
        self.pivots = mix64(np.arange(1, PIVOTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.masks = [U64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.pairs = list(combinations(range(blocks), 2))

    def rows(self, fp: np.ndarray) -> np.ndarray:
        """(blocks, n, PIVOTS) distances inside each block."""
        apart = fp[:, None] ^ self.pivots[None, :]
        return np.stack([np.bitwise_count(apart & m) for m in self.masks])

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """(n, pairs of blocks): one key per table rows of two blocks."""
        odd = mix64(np.arange(11, 11 + PIVOTS, dtype=U64)) | U64(1)
        block = [mix64((r.astype(U64) * odd).sum(1, dtype=U64)) for r in self.rows(fp)]
        return np.stack([mix64(block[a] * U64(3) + block[b] * U64(5) + U64(i))
                         for i, (a, b) in enumerate(self.pairs)], axis=1)

    def near(self, table: np.ndarray, fp: np.ndarray, i, j) -> np.ndarray:
        """Which index pairs are within max_bits: by coordinates, then exactly."""
        ok = (np.abs(table[i] - table[j]) <= self.max_bits).all(-1)
        return ok & (np.bitwise_count(fp[i] ^ fp[j]) <= self.max_bits)


def linked(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that span the
    same components as all pairs within ``max_bits`` bits."""
    pivot = PivotTable(max_bits)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            keys = pivot.keys(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))],
                names=["key", "fp"])

    def meet(batches):
        for batch in runs(batches):
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            table = pivot.rows(fp).sum(0).astype(np.int16)
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            length = np.diff(ends, prepend=0)
            size = np.repeat(length, length)  # of each row's run
            left, right = [], []
            for lag in range(1, int(min(16, size.max()))):  # small runs: all pairs, lag by lag
                i = np.flatnonzero((key[lag:] == key[:-lag]) & (size[lag:] <= 16))
                i = i[pivot.near(table, fp, i, i + lag)]
                left.append(fp[i])
                right.append(fp[i + lag])
            for end in ends[length > 16]:  # large runs: what is reached leaves the pool
                pool = np.arange(end - size[end - 1], end)
                while len(pool) > 1:
                    todo, pool = [pool[0]], pool[1:]
                    while todo and len(pool):
                        hit = pivot.near(table, fp, todo[-1], pool)
                        found, at = pool[hit], todo.pop()
                        left.append(np.full(len(found), fp[at]))
                        right.append(fp[found])
                        todo.extend(found)
                        pool = pool[~hit]
            a = np.concatenate(left) if left else np.zeros(0, U64)
            b = np.concatenate(right) if right else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = in_arrow(fps.select("fp"), deal, "key long, fp long")
    return (in_arrow(dealt.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp"), meet, "a long, b long"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keep_hash) per row. component_id
    is the smallest doc_id reachable over links of at most ``max_bits`` bits;
    keep_hash is the text hash of the row that stands for the component."""
    rows = materialize(fingerprints(docs, doc_id, text, width))
    # the smallest (doc_id, text_hash) stands for its fingerprint and component; nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    fps = materialize(rows.groupBy("fp").agg(first))
    roots = components(linked(fps, max_bits))
    member = (fps.join(roots, fps["fp"] == roots["node"], "left")
                 .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    heads = member.groupBy("root").agg(F.min("first").alias("head"))
    member = materialize(member.join(heads, "root").select(
        F.col("fp").alias("m_fp"), F.col("head.doc_id").alias("component_id"),
        F.col("head.text_hash").alias("keep_hash")))
    return rows.join(member, rows["fp"] == member["m_fp"]).drop("m_fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
             max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one row each."""
    from pyspark.sql import Window
    kept = (simhash_groups(docs, doc_id, text, width, max_bits)
            .select(F.col("component_id").alias("k_id"), F.col("keep_hash").alias("k_hash"))
            .distinct())
    h, n = fresh(docs, "k_text_hash"), fresh(docs, "k_row")
    rows = docs.withColumn(h, F.xxhash64(text))
    rows = rows.join(kept, rows[doc_id].cast("long").eqNullSafe(kept["k_id"]) & (rows[h] == kept["k_hash"]), "left_semi")
    once = Window.partitionBy(doc_id, h).orderBy(F.lit(0))
    return rows.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
