"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, open_store, ship


U64 = np.uint64
#: \x20 and \x09-\x0D separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark's own setting: an execution's shuffle files go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder, read again. What was
    shuffled on the way is deleted, as nothing needs it once all is written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        fs, path = open_store(df._written_to)
        fs.delete_dir(path)


def give_back() -> None:
    """Hand memory that is free again back to the machine: a Python worker
    lives on for the tasks of other operators, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on every executor."""
    ship(df.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame already has such a column
    (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(col) -> F.Column:
    """crc32 of an id written as text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


# --- numpy over Arrow text -------------------------------------------------

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and, for each row, the index of its
    first word (one more entry than rows). Words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~_SPACE[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    inner = off[off < len(buf)]
    before[inner] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[off[off > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POW = _INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _POW, _INV = made
    return _POW, _INV


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running sum over the bytes."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first ``keys`` columns, cut so that no
    run of equal keys spans two of them (a run may be a batch of its own)."""
    held: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> int:
        """First row of the last run."""
        same = np.ones(batch.num_rows - 1, bool)
        for k in range(keys):
            col = batch.column(k)
            same &= np.asarray(col.slice(1).to_numpy(zero_copy_only=False)
                               == col.slice(0, batch.num_rows - 1).to_numpy(zero_copy_only=False))
        breaks = np.flatnonzero(~same)
        return int(breaks[-1]) + 1 if len(breaks) else 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.concat_batches(parts) if len(parts) > 1 else parts[0]

    def key(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(k)[row].as_py() for k in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield joined(held)
            held = []
        at = cut(batch)
        if at:
            yield joined([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield joined(held)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text (one row at least)."""
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct strings of a column of lists, the number of each string in
    them, and where each row's strings start (one more entry than rows)."""
    found = lists.flatten().dictionary_encode()
    ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    return found.dictionary.to_pylist(), found.indices.to_numpy(), ends


def tokens(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Blank-separated tokens of a string column, as ``coded``; null counts as
    empty, and every row has a token (the empty string, at its ends)."""
    return coded(pc.utf8_split_whitespace(col.cast(pa.large_string()).fill_null("")))


class TokenRows:
    """Rows of numbers of blank-separated tokens, made when first met (by
    ``make``, or many at once by ``make_all``). At most ``most`` tokens are
    kept (more only while one call has more); then all are dropped and what is
    frequent comes back."""

    def __init__(self, width: int, make=None, most: int = 500_000, make_all=None):
        self.make_all = make_all or (lambda tokens: [make(t) for t in tokens])
        self.most = most
        self.index: dict[str, int] = {}
        self.rows = np.zeros((most, width))

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """One row per token."""
        at = list(map(self.index.get, tokens))
        if None in at:
            new = {t for t in set(tokens) if t not in self.index}
            if len(self.index) + len(new) > self.most:
                self.index.clear()
                new = set(tokens)
                if len(new) > len(self.rows):
                    self.rows = np.zeros((len(new), self.rows.shape[1]))
            order, first = list(new), len(self.index)
            self.index.update(zip(order, range(first, first + len(order)), strict=True))
            self.rows[first:first + len(order)] = self.make_all(order)
            at = list(map(self.index.get, tokens))
        return self.rows[at]


# --- connected components --------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns a, b) that
    is not itself the smallest of its component; root is that smallest node.

    Alternating large-star / small-star rounds. Every step is a partial
    aggregate or an equi-join whose hot keys AQE can split, and each round's
    edges are written to the shared folder."""
    spark = edges.sparkSession

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return (both.join(least, "a").where("b > a")
                    .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                   F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        old, now = now, materialize(small(large(now)))
        after = state(now)
        discard(old)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) if seen[0] else \
        spark.createDataFrame([], "node long, root long")
