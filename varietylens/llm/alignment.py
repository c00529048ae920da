"""Cross-tokenizer alignment: divide and conquer at shared cuts.

Two tokenizers cut the bytes of a blank and a text: A byte-level BPE, B
SentencePiece (which adds the blank). A byte offset where tokens of both end is
a shared cut; the tokens between two neighbouring cuts are a group.

1. In an interval of tokens between two cuts the middle end of A, then ever
   farther ones on either side, is looked up among B's ends by bisection; the
   first that B has is a cut, and both halves are treated in the same way. An
   interval without cut, or with a single token of A or of B, is a leaf group.
   All intervals of a block of texts advance together, a level at a time.
2. Within a group every stretch between neighbouring ends (of either) is a link
   of the two tokens over it. Links of a pair of ids are counted over all
   texts, and for each id of B the highest count is kept.
3. Every text gets its links' counts back.

Neither tokenizer joins bytes across a single blank between other characters,
so such texts fall into pieces at their blanks; a block of texts (up to
``BLOCK`` bytes, or one longer text) encodes and aligns its distinct pieces
once. Texts with other blanks are one piece. What is shuffled are a block's
distinct id pairs, and per text the numbers of its pieces. A block's arrays are
written as rows of at most ``CODES`` codes: Parquet and Arrow hold back a number
of rows, whatever their size, so what a task holds must not grow with its blocks.

Null and empty texts, and texts whose bytes one tokenizer does not give back,
have no tokens: zeros and an empty string. Rows are documents of their own,
repeated and null ids too; other columns of the input are not read.
"""

from __future__ import annotations

import os
import uuid
from hashlib import sha256
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, give_back, in_arrow, materialize, partitions, text_slices
from ..session import ensure_checkpoint_dir

BLOCK, CALL, CODES = 8 << 20, 50_000, 1 << 15
_ROW_GROUP = 16 << 20  # bytes that a writer holds
_PARTS = ("block long, kind int, part int, body binary, ends binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups string")
_NONE = np.zeros(0, np.int64)


class Aligned(NamedTuple):
    documents: DataFrame  # doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups
    counts: DataFrame     # a_id, b_id, n, best: links of every pair of ids


def byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand
    for themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> np.ndarray:
    """Which ends ``a`` are shared with ``b`` (both rising). Interval i has the
    tokens from a_from[i] to a_from[i + 1], and so for b; none is empty, and
    the last ends of an interval are shared."""
    shared = np.zeros(len(a), bool)
    shared[a_from[1:] - 1] = True
    lo, hi, blo, bhi = a_from[:-1], a_from[1:], b_from[:-1], b_from[1:]
    while True:
        some = (hi - lo > 1) & (bhi - blo > 1)
        lo, hi, blo, bhi = lo[some], hi[some], blo[some], bhi[some]
        if not len(lo):
            return shared
        middle = (lo + hi - 2) // 2  # ends lo .. hi - 2 are inside
        at, other = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        todo, step = np.arange(len(lo)), 0
        while len(todo):
            for sign in (1, -1) if step else (1,):
                p = middle[todo] + sign * step
                inside = (p >= lo[todo]) & (p <= hi[todo] - 2) & (at[todo] < 0)
                which, p = todo[inside], p[inside]
                j = np.searchsorted(b, a[p])
                hit = b[j] == a[p]
                at[which[hit]], other[which[hit]] = p[hit], j[hit]
            step += 1
            todo = todo[(at[todo] < 0) & ((middle[todo] - step >= lo[todo]) | (middle[todo] + step <= hi[todo] - 2))]
        found = at >= 0
        shared[at[found]] = True
        at, other = at[found] + 1, other[found] + 1
        lo, hi, blo, bhi = (np.concatenate(x) for x in (
            (lo[found], at), (at, hi[found]), (blo[found], other), (other, bhi[found])))


class Tokens(NamedTuple):
    """Token ids of many strings: those of string i from at[i] to at[i + 1]."""
    ids: np.ndarray
    at: np.ndarray

    def only(self, keep: np.ndarray) -> Tokens:
        n = np.diff(self.at)
        return Tokens(self.ids[np.repeat(keep, n)], np.append(0, np.cumsum(n[keep])))


class Pair:
    """Both tokenizers and the tables of their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path)
        vocab, byte = self.a.get_vocab(), byte_of()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.width = [np.array([len(t) for t in x]) for x in (a_bytes, b_bytes)]
        self.n_b = len(b_bytes)
        n_a = len(a_bytes)
        self.marks = [0, n_a, 2 * n_a, 2 * n_a + self.n_b]  # where the strings with , | , ; begin
        self.said = pa.array([f"{i}{m}" for n, m in ((n_a, ","), (n_a, "|"), (self.n_b, ","), (self.n_b, ";"))
                              for i in range(n)], pa.large_string()).cast(pa.large_binary())

    def whole(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of whole texts, whatever blanks they hold."""
        a = [self.a.encode_batch_fast([" " + t], add_special_tokens=False)[0].ids for t in texts]
        return _tokens(a), _tokens(self.b.encode(texts, num_threads=1) if texts else [])

    def pieces(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of strings that neither begin nor end with a blank; for A
        many are one text, as no token goes across their blanks."""
        ids, lengths, b = [_NONE], [_NONE], []
        for at in range(0, len(texts), CALL):
            part = texts[at:at + CALL]
            got = np.array(self.a.encode_batch_fast(["".join([" " + t for t in part])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(t.encode()) + 1 for t in part])
            upto = np.searchsorted(np.cumsum(self.width[0][got]), ends) + 1
            ids.append(got)
            lengths.append(np.diff(upto, prepend=0))
            b += self.b.encode(part, num_threads=1)
        return Tokens(np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(lengths)))), _tokens(b)

    def gives_back(self, which: int, tokens: Tokens, texts: list[str]) -> np.ndarray:
        """Whether the tokens' bytes are those of a blank and the text."""
        laid = self.bytes[which].take(pa.array(tokens.ids))
        _, offsets, data = laid.buffers()
        at = np.frombuffer(offsets, np.int64, len(laid) + 1)[tokens.at].tolist()
        data = memoryview(data or b"").cast("B")
        return np.array([data[lo:hi] == b" " + t.encode() for (lo, hi), t in zip(pairwise(at), texts, strict=True)], bool)

    def groups(self, a: Tokens, b: Tokens):
        """Of aligned strings: groups per string, the groups written down (each
        ends with a semicolon), link codes and where each string's begin."""
        a_ends, b_ends = np.cumsum(self.width[0][a.ids]), np.cumsum(self.width[1][b.ids])
        shared = cuts(a_ends, b_ends, a.at, b.at)
        last_a = np.flatnonzero(shared)
        last_b = np.searchsorted(b_ends, a_ends[last_a])
        # A's tokens of a group, then B's: the place of each among all
        p, q = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        said = np.zeros(len(a.ids) + len(b.ids), np.int64)
        said[np.arange(len(a.ids)) + np.repeat(last_b + 1 - q, p)] = a.ids + np.where(shared, self.marks[1], self.marks[0])
        final = np.zeros(len(b.ids), bool)
        final[last_b] = True
        said[np.arange(len(b.ids)) + np.repeat(last_a + 1, q)] = b.ids + np.where(final, self.marks[3], self.marks[2])
        laid = self.said.take(pa.array(said))
        _, offsets, data = laid.buffers()
        at = np.frombuffer(offsets, np.int64, len(laid) + 1)[a.at + b.at]
        written = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), data])
        # a link per stretch between neighbouring ends
        ends = np.union1d(a_ends, b_ends)
        links = a.ids[np.searchsorted(a_ends, ends)] * self.n_b + b.ids[np.searchsorted(b_ends, ends)]
        before = np.append(0, a_ends)[a.at]  # bytes before each string
        return (np.diff(np.searchsorted(last_a, a.at)), written, links, np.searchsorted(ends, before, "right"))


def _tokens(lists: list[list[int]]) -> Tokens:
    at = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    return Tokens(np.fromiter((i for x in lists for i in x), np.int64, int(at[-1])), at)


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    return np.diff(np.append(0, np.cumsum(values))[at])


def align_block(pair: Pair, col: pa.Array, digest: bool):
    """One block of texts. Returns (n_a, n_b, n_groups, n_links, groups, words)
    per text, words being the numbers of its pieces, and of the pieces the link
    codes, where they begin, and how often each piece stands in the block."""
    col = col.cast(pa.large_string()).fill_null("")
    found, words, first = coded(pc.split_pattern(col, " "))
    odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in found], bool)
    strange = _sums(odd[words], first) > 0
    loose = np.flatnonzero(strange)  # texts of other blanks: one piece each
    texts = [col[int(i)].as_py() for i in loose]
    used = np.bincount(words[~np.repeat(strange, np.diff(first))], minlength=len(found)) > 0
    plain = np.flatnonzero(used)
    number = np.cumsum(used) - 1
    strings = [found[i] for i in plain] + texts
    whole, split = pair.whole(texts), pair.pieces([found[i] for i in plain])
    a, b = (Tokens(np.concatenate([x.ids, y.ids]), np.append(x.at, x.at[-1] + y.at[1:])) for x, y in zip(split, whole, strict=True))
    good = pair.gives_back(0, a, strings) & pair.gives_back(1, b, strings) & np.array([bool(s) for s in strings], bool)
    a, b = a.only(good), b.only(good)
    n_groups, written, links, at = pair.groups(a, b)
    place = np.cumsum(good) - 1
    place[~good] = -1
    # each text's pieces, one number for a text of other blanks
    lists = [words[lo:hi] for lo, hi in pairwise(first.tolist())]
    lists = [number[x] for x in lists]
    for k, i in enumerate(loose.tolist()):
        lists[i] = np.array([len(plain) + k])
    lists = [place[x] for x in lists]
    lists = [x if (x >= 0).all() else _NONE for x in lists]
    first = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    words = np.concatenate([*lists, _NONE])
    n_a, n_b = _sums(np.diff(a.at)[words], first), _sums(np.diff(b.at)[words], first)
    groups, n_links = _sums(n_groups[words], first), _sums(np.diff(at)[words], first)
    laid = written.take(pa.array(words))
    _, offsets, data = laid.buffers()
    ends = np.frombuffer(offsets, np.int64, len(laid) + 1)[first].tolist()
    data = memoryview(data or b"").cast("B")
    bodies = (data[lo:max(lo, hi - 1)] for lo, hi in pairwise(ends))
    said = ["" if not len(x) else sha256(x).hexdigest() if digest else bytes(x).decode() for x in bodies]
    return (n_a, n_b, groups, n_links, said, lists), (links, at, np.bincount(words, minlength=len(at) - 1))


def _raw(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _pieces(at: np.ndarray):
    """(first, last + 1) piece of runs of at most ``CODES`` codes (or one piece)."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CODES, "right")) - 1)
        yield lo, min(hi, lo + CODES)
        lo = min(hi, lo + CODES)


def _block_rows(a_path: str, b_path: str, digest: bool):
    """Rows of _PARTS: of kind 0 a block's distinct link codes and counts, of
    kind 1 its pieces' codes, both a part at a time, of kind 2 its texts with their
    piece numbers."""
    def run(batches):
        pair, n = _pair(a_path, b_path), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in text_slices(batch, 1, BLOCK):
                docs, (links, at, often) = align_block(pair, part.column(1), digest)
                block, n, rows = (task << 32) + n, n + 1, part.num_rows
                codes, where = np.unique(links, return_inverse=True)
                counts = np.bincount(where, np.repeat(often, np.diff(at)), len(codes)).astype(np.int64)
                codes, counts = codes[counts > 0], counts[counts > 0]  # a text without tokens may hold other pieces
                arrays = [(0, k, codes[lo:lo + CODES], counts[lo:lo + CODES]) for k, lo in enumerate(range(0, len(codes), CODES))]
                arrays += [(1, k, links[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]) for k, (lo, hi) in enumerate(_pieces(at))]
                cols = [[block] * (len(arrays) + rows), [x[0] for x in arrays] + [2] * rows, [x[1] for x in arrays] + [None] * rows,
                        [_raw(x[2], "<i8") for x in arrays] + [_raw(x, "<u4") for x in docs[5]],
                        [_raw(x[3], "<i8") for x in arrays] + [None] * rows]
                none = [None] * len(arrays)
                cols += [none + list(x) for x in (part.column(0).to_pylist(), *(x.tolist() for x in docs[:4]), docs[4])]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=[c.split()[0] for c in _PARTS.split(", ")])
                del docs, links, at, often, codes, where, counts, arrays, cols
                give_back()  # else a task of many blocks keeps what each of them left
    return run


def _pair_rows(batches):
    """(block, pair, n) from rows of kind 0."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, body, ends = (c[i].as_py() for c in batch.columns)
            codes = np.frombuffer(body, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(np.frombuffer(ends, "<i8"))], names=["block", "pair", "n"])


def _document_rows(batches):
    """Per text the number of its best links and the sum of its links' counts,
    from rows in order of block, kind and part: first the block's counted pairs, then
    its pieces, then its texts."""
    now, pairs, table, best, total = None, [], None, [], []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks))
        out = []
        for lo, hi in pairwise([0, *edges.tolist()] if len(blocks) else []):
            if blocks[lo] != now:
                now, pairs, table, best, total = blocks[lo], [], None, [_NONE], [_NONE]
            part = batch.slice(lo, hi - lo)
            kind = part.column(1).to_numpy()
            counted = part.slice(0, int((kind == 0).sum()))
            if counted.num_rows:
                pairs.append([counted.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)])
            for i in np.flatnonzero(kind == 1).tolist():
                if table is None:
                    code, n, high = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (_NONE, _NONE, np.zeros(0, bool))
                    order, pairs = np.argsort(code), []
                    table = code[order], n[order], high[order]
                links, at = (np.frombuffer(part.column(c)[i].as_py(), "<i8") for c in (6, 7))
                code, n, high = table
                if not len(code):  # no text has tokens
                    best.append(np.zeros(len(at) - 1, np.int64))
                    total.append(best[-1])
                    continue
                place = np.minimum(np.searchsorted(code, links), len(code) - 1)
                best.append(_sums(high[place].astype(np.int64), at))
                total.append(_sums(n[place], at))
            texts = part.slice(int((kind < 2).sum()))
            if texts.num_rows:
                best, total = [np.concatenate(best)], [np.concatenate(total)]
                words = [np.frombuffer(x, "<u4") for x in texts.column(6).to_pylist()]
                first = np.append(0, np.cumsum([len(x) for x in words])).astype(np.int64)
                words = np.concatenate(words)
                out.append((texts, _sums(best[0][words], first), _sums(total[0][words], first)))
        for texts, high, n in out:
            yield pa.RecordBatch.from_arrays([*texts.columns[8:13], pa.array(high), pa.array(n), texts.column(13)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
          digest: bool = False) -> Aligned:
    """Align the tokens of every text. ``groups`` is `a1,a2|b1;a3|b2,b3`
    (decimal ids, groups in order), or with ``digest`` its SHA-256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    in_arrow(rows, _block_rows(a_path, b_path, digest), _PARTS).write.partitionBy("kind") \
        .option("compression", "zstd").option("parquet.block.size", str(_ROW_GROUP)).parquet(path)
    parts = spark.read.schema(_PARTS).parquet(path)
    n_b = _pair(a_path, b_path).n_b
    pairs = in_arrow(parts.where("kind = 0").select("block", "body", "ends"), _pair_rows, "block long, pair long, n long")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    # a row per id of B, so no more than its vocabulary
    b_id = F.col("pair") % n_b
    best = counts.groupBy(b_id.alias("m_b")).agg(F.max("n").alias("m_n"))
    counts = counts.join(F.broadcast(best), b_id == F.col("m_b")).select("pair", "n", (F.col("n") == F.col("m_n")).alias("best"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _PARTS.split(", ")[3:])]
    part = F.lit(None).cast("int").alias("part")
    back = pairs.select("block", "pair").join(counts, "pair").select("block", F.lit(0).alias("kind"), part, "pair", "n", "best", *empty)
    no = [F.lit(None).cast(t).alias(c) for c, t in (("pair", "long"), ("n", "long"), ("best", "boolean"))]
    kept = parts.where("kind > 0").select("block", "kind", "part", *no, *(c.split()[0] for c in _PARTS.split(", ")[3:]))
    ordered = back.union(kept).repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "part")
    documents = in_arrow(ordered, _document_rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                                  "count_sum long, groups string")
    return Aligned(documents, counts.select((F.col("pair") / n_b).cast("long").alias("a_id"), b_id.alias("b_id"), "n", "best"))
