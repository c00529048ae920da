"""Packing token sequences: shortest-pack-first over the length histogram.

1. Texts become token ids (plus an end id) and are cut into pieces of at most
   ``size`` ids.
2. The histogram of piece lengths (at most ``size`` rows) is packed on the
   driver: lengths longest first, each into the packs with most room left,
   updating counts of packing patterns, never single pieces.
3. Patterns become slots: for a length, ranks from .. to sit in consecutive
   sequences at one offset. Pieces are ranked within their length, and a rank
   finds its slot by bisection.

Null and empty texts are one piece holding the end id. Repeated rows and null
ids are documents of their own; very long texts are cut like any other; an
empty table has no pieces. Ranks are counted per (length, salt), with a salt
for every ``GROUP`` pieces of a length, so no group grows with the input.
Columns of any name are carried along; added ones get a longer name if theirs
is taken.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded, fresh, in_arrow, materialize, text_slices

#: Pieces of a length that are ranked together.
GROUP = 200_000

#: Letters with sentence marks behind them are two tokens of the byte-level
#: pre-tokenizer, whatever stands around them.
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A single blank between non-blanks always starts a token of the byte-level
    pre-tokenizer, so such texts are encoded blank by blank, from a cache of
    pieces (two bounded generations); texts with other blanks are encoded whole."""

    def __init__(self, path: str, cache: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: one character each
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.most = cache
        self.young: dict[str, bytes | None] = {}  # None: a piece with blanks at its ends
        self.old: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a blank before it, by one call."""
        ids = self.whole("".join([" " + p for p in pieces]))
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        at = (np.searchsorted(np.cumsum(self.width[np.frombuffer(ids, "<u4")]), ends) + 1) * 4
        return [ids[a:b] for a, b in pairwise([0, *at.tolist()])]

    def _learn(self, need: list[str]) -> None:
        """All of ``need`` (distinct pieces) are in ``young`` afterwards, however many there are."""
        missing = [p for p in need if p not in self.young]
        if missing and len(self.young) + len(missing) > self.most:
            self.old, self.young, missing = self.young, {}, need
        young, old, new, split = self.young, self.old, set(), []
        for p in missing:
            if p in old:
                young[p] = old[p]
            elif p.isalpha():
                new.add(p)
            elif not p or p[0].isspace() or p[-1].isspace():
                young[p] = None
            elif (m := _PLAIN.fullmatch(p)) and m[1].isalpha():
                split.append((p, m[1], m[2]))
                if m[1] not in young:
                    new.add(m[1])
            else:
                new.add(p)
        order = list(new)
        if order:
            young.update(zip(order, self._encode(order), strict=True))
        for p, word, mark in split:
            if mark not in self.marks:
                self.marks[mark] = self.whole(mark)
            young[p] = young[word] + self.marks[mark]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column without nulls."""
        if not len(texts):
            return
        found, codes, ends = coded(pc.split_pattern(texts.cast(pa.large_string()), " "))
        self._learn(found)
        first = codes[ends[:-1]]
        heads, head = np.unique(first, return_inverse=True)  # no blank before a text's first piece
        ids = list(map(self.young.__getitem__, found))
        odd = np.array([i is None for i in ids])
        codes = codes.copy()
        codes[ends[:-1]] = len(found) + head
        known = pa.array([i or b"" for i in ids] + [self.whole(found[h]) for h in heads.tolist()], pa.large_binary())
        laid = known.take(pa.array(codes))
        _, offsets, data = laid.buffers()
        at = np.frombuffer(offsets, np.int64, len(laid) + 1)[ends].tolist()
        whole = (np.add.reduceat(np.append(odd, np.zeros(len(heads), bool))[codes], ends[:-1]) > 0) | odd[first]
        for i, (lo, hi) in enumerate(pairwise(at)):
            yield self.whole(texts[i].as_py()) if whole[i] else data[lo:hi].to_pybytes() if hi > lo else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python process, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id",
           text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) per piece; ids are the bytes
    of little-endian unsigned 32-bit integers, or with ``digest`` their CRC-32
    takes their place (ids_crc32). Written to the shared folder."""
    tail = np.array([end_id], "<u4").tobytes()
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    names = ["doc_id", "start", "length", "doc_tokens", last]
    seen = zlib.crc32 if digest else bytes

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                texts = own.encode(part.column(1).fill_null(""))
                for doc, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = memoryview(ids + tail)
                    n = len(ids) // 4
                    rows += [(doc, s, min(size, n - s), n, seen(ids[4 * s:4 * (s + size)])) for s in range(0, n, size)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], kind)], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = f"doc_id long, start long, length long, doc_tokens long, {last} {'long' if digest else 'binary'}"
    return materialize(in_arrow(rows, run, kinds), compression="zstd")


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, how many packs) for counts of lengths."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # kept sorted

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            if rooms and rooms[-1] >= length:  # the shortest packs
                room = rooms[-1]
                pattern, n = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room], rooms[-1]
                used, fit = min(n, left), 1
                if used == n:  # once more while these stay the shortest
                    rival = room if room in by_room else rooms[-1] if rooms else 0
                    fit = max(1, min(room // length, (room - rival) // length + 1, left // used))
                if n > used:
                    put(room, pattern, n - used)
                put(room - fit * length, pattern + (length,) * fit, used)
                left -= used * fit
            else:
                fit = min(size // length, left)
                put(size - fit * length, (length,) * fit, left // fit)
                left -= left // fit * fit
    return [(p, n) for room in rooms for p, n in by_room[room].items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) per pattern place."""
    out, taken, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            at = taken.get(length, 0)
            out.append((length, at, at + n, first, offset))
            taken[length] = at + n
            offset += length
        first += n
    return out


def place(rows: DataFrame, size: int = 1024, order: tuple = ("doc_id", "start"), group: int = GROUP) -> DataFrame:
    """``rows`` (one per piece, with a column length) with ``sequence_id`` and
    ``offset`` as last columns. Columns that are not used need not be there:
    whoever needs the ids in their sequences keeps that column."""
    spark, names = rows.sparkSession, rows.columns
    salt, rank, before, salts, n = (fresh(rows, c) for c in ("p_salt", "p_rank", "p_before", "p_salts", "p_n"))
    added = [fresh(rows, c) for c in ("sequence_id", "offset")]
    # a row per length, so at most ``size`` rows
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = slots(pack_histogram(counts, size))
    many = spark.createDataFrame([(k, -(-c // group)) for k, c in counts.items()], f"length long, {salts} long")
    salted = rows.join(F.broadcast(many), "length").withColumn(salt, F.pmod(F.xxhash64(*order), F.col(salts)))
    number = F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1
    if any(c > group for c in counts.values()):  # a row for every ``group`` pieces
        counted = salted.groupBy("length", salt).agg(F.count("*").alias(n))
        offsets = materialize(counted.select("length", salt, (F.sum(n).over(
            Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(before)))
        ranked = salted.withColumn(rank, number).join(offsets, ["length", salt]).withColumn(rank, F.col(rank) + F.col(before))
    else:
        ranked = salted.withColumn(rank, number.cast("long"))
    # the slots are patterns of lengths: some for each length, whatever the number of pieces
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(table)
    at = names.index("length")

    def run(batches):
        length, first, _, sequence, offset = table.value.T
        begins = np.searchsorted(length, np.arange(size + 2))
        for batch in batches:
            own, r = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            slot = np.zeros(len(own), np.int64)
            for k in np.unique(own).tolist():
                rows_of = np.flatnonzero(own == k)
                lo, hi = begins[k], begins[k + 1]
                slot[rows_of] = lo + np.searchsorted(first[lo:hi], r[rows_of], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[slot] + r - first[slot]), pa.array(offset[slot])],
                                             names=[*names, *added])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    return in_arrow(ranked.select(*names, F.col(rank).cast("long")), run, schema)
