"""Substring dedup: paragraph MinHash banding.

A paragraph here is a passage of ``2 * HALF`` words around a content-defined
anchor (winnowing: of every ``SPAN`` word pairs in a row the one of the
smallest hash). So a passage that stands anywhere in two documents, whatever
surrounds it and wherever lines break, gives the same paragraphs in both:
``2 * HALF + SPAN - 1`` shared words hold a whole paragraph. Every text of five
words has an anchor; at its ends paragraphs are shorter.

1. Every paragraph gets a hash of its words and MinHash bands over its
   five-word shingles (``BANDS`` bands of ``ROWS``: a pair of Jaccard 0.8 meets
   with probability 0.98, 0.9 with 0.999, equal ones always).
2. Paragraphs that meet in a band are joined and verified by their exact
   Jaccard measure (0.8 or more); classes are the connected components.
3. Of a class found in several documents, the first document (by doc_id, null
   last, then text hash) keeps its paragraphs; they are cut out of the others.
4. What is cut grows at both ends, word by word, while the words agree with
   the keeper's (at most ``CONTEXT`` words: an agreement of that length holds
   paragraphs of its own). Where paragraphs of one cut have several keepers, each is tried
   from its ``TRIED`` paragraphs next to the end.

A band group of up to ``GROUP`` different paragraphs is verified by one task,
which looks for candidates by rare shingles (prefix filter), never at all
pairs. Larger groups (a line that half the corpus contains, in ever other
surroundings) are split exactly: two sets of at most twelve shingles and
Jaccard 0.8 differ by two shingles at most, so they agree once one or two are
left out; what is left is the join key, and members of a key are linked to its
smallest. No group lies in one task and no pair of a group is lost.

Rows with equal doc_id and text are one document. Null, empty and texts of
fewer than five words have no paragraphs and stay as they are; very long texts
are read in full, an empty table gives an empty one. Columns of any name are
carried along; added ones get a longer name if theirs is taken.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (_powers, components, discard, fresh, in_arrow, materialize, mix64, partitions, runs, text_bytes, text_slices,
                     word_hashes, word_spans)

HALF, SPAN, WIDTH, JACCARD = 8, 35, 5, 0.8
SHINGLES = 2 * HALF - WIDTH + 1  # of a paragraph; ``left_out`` holds for 12 at Jaccard 0.8
CONTEXT, MEET = 2 * (SPAN + HALF), 32  # words; bytes by which neighbouring cuts grow into each other
BANDS, ROWS, GROUP = 4, 2, 4096  # BANDS: a power of two, the last bits of a key are its band
U64 = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SALT = mix64(np.arange(1, 1 + BANDS * ROWS, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:have - width], x[width - have:]) if have < width else x


def _anchors(x: np.ndarray) -> np.ndarray:
    """Places of the smallest value (the first of equal ones) of every ``SPAN``
    values in a row, or of all if there are fewer."""
    width = min(SPAN, len(x))
    least = _sliding(x, width, np.minimum)
    edge = np.zeros(width - 1, U64)
    # a value is the least of a window if the largest of its windows' least is no smaller
    found = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == x)
    if len(np.unique(x[found])) == len(found):
        return found
    chosen = np.zeros(len(x), bool)  # equal values: look for the first in each window
    todo = np.arange(len(least))
    for step in range(width):
        hit = x[todo + step] == least[todo]
        chosen[todo[hit] + step] = True
        todo = todo[~hit]
    return np.flatnonzero(chosen)


def _all_anchors(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the anchors of many texts at once; text i has the
    values first[i] to first[i + 1]."""
    n, inside = np.diff(first), np.zeros(len(x) + 1, np.int8)
    long = n >= SPAN
    inside[first[:-1][long]] += 1
    np.add.at(inside, first[1:][long] - SPAN + 1, -1)
    chosen = np.zeros(len(x), bool)
    if long.any():
        least = _sliding(x, SPAN, np.minimum)
        least[np.cumsum(inside[:len(least)]) == 0] = 0  # a window of two texts
        edge = np.zeros(SPAN - 1, U64)
        chosen = _sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum) == x
    short = np.flatnonzero((n > 0) & ~long)  # one window each
    if len(short):
        begin = first[:-1][n > 0]
        least = np.zeros(len(n), U64)
        least[n > 0] = np.minimum.reduceat(x, begin)
        row = np.repeat(short, n[short])
        at = np.arange(len(row)) + np.repeat(first[short] - np.append(0, np.cumsum(n[short]))[:-1], n[short])
        chosen[at] = x[at] == least[row]
    at = np.flatnonzero(chosen)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((x[at], row))
    again = np.unique(row[order][1:][(row[order][1:] == row[order][:-1]) & (x[at][order][1:] == x[at][order][:-1])])
    if len(again):  # equal values: the first of each window
        parts = [first[i] + _anchors(x[first[i]:first[i + 1]]) for i in again.tolist()]
        rest = ~np.isin(row, again)
        at = np.sort(np.concatenate([at[rest], *parts]))
        row = np.searchsorted(first, at, "right") - 1
    return at, row


def cut(buf: np.ndarray, off: np.ndarray):
    """Paragraphs of the texts in (buf, off): row, first and end word; and all
    words' starts, ends and hashes."""
    starts, ends, first = word_spans(buf, off)
    h = word_hashes(buf, starts, ends)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, starts, ends, h
    after = np.append(h[1:], U64(0))
    after[first[1:][np.diff(first) > 0] - 1] = 0
    at, row = _all_anchors(mix64(h * U64(3) + after), first)
    lo, hi = np.maximum(at - HALF, first[row]), np.minimum(at + HALF, first[row + 1])
    keep = hi - lo >= WIDTH
    return row[keep], lo[keep], hi[keep], starts, ends, h


def _gaps(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each paragraph the word at which the next one of its text begins (or
    the text ends, or it ends itself if that is later)."""
    return np.maximum(np.where(np.append(row[1:] == row[:-1], False), np.append(lo[1:], 0), first[row + 1]), hi)


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hash of the WIDTH words from each word on."""
    out = np.zeros(max(0, len(h) - WIDTH + 1), U64)
    for i in range(WIDTH):
        out += h[i:i + len(out)] * _SALT[i]
    return mix64(out)


def _word_sums(h: np.ndarray) -> np.ndarray:
    return np.append(U64(0), np.cumsum(h * _powers(len(h) + 1)[0][:len(h)], dtype=U64))


def _words_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words from lo to hi, from running sums over their hashes."""
    return mix64((sums[hi] - sums[lo]) * _powers(len(sums))[1][lo] + (hi - lo).astype(U64))


def sketch(lo: np.ndarray, hi: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of all words, band keys) of the paragraphs lo..hi over word hashes h."""
    if not len(lo):
        return np.zeros(0, U64), np.zeros((0, BANDS), U64)
    count = hi - lo - WIDTH + 1
    # a short paragraph repeats its last shingle
    own = _shingles(h)[lo[:, None] + np.minimum(np.arange(SHINGLES)[None, :], count[:, None] - 1)]
    keys = np.zeros((len(lo), BANDS), U64)
    for band in range(BANDS):
        for r in range(ROWS):
            salt = _SALT[band * ROWS + r]
            keys[:, band] = mix64(keys[:, band] + mix64(own * salt).min(1))
        keys[:, band] = keys[:, band] & ~U64(BANDS - 1) | U64(band)
    return _words_hash(_word_sums(h), lo, hi), keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _paragraph_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("doc"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text"))


def _band_rows(batches):
    """(key, par, many): per batch each band key and paragraph hash once; many:
    in several documents of the batch."""
    for batch in batches:
        keys, pars, docs = [], [], []
        for part in text_slices(batch, 2):
            row, lo, hi, _, _, h = cut(*text_bytes(part.column(2)))
            exact, k = sketch(lo, hi, h)
            keys.append(k)
            pars.append(exact)
            docs.append(part.column(0).to_numpy()[row])
        par, doc = np.concatenate(pars), np.concatenate(docs)
        order = np.lexsort((doc, par))
        par, doc = par[order], doc[order]
        head = np.flatnonzero(np.append(True, par[1:] != par[:-1])) if len(par) else np.zeros(0, int)
        many = doc[head] != doc[np.append(head[1:], len(par)) - 1] if len(par) else np.zeros(0, bool)
        key = np.concatenate(keys)[order[head]]
        yield pa.RecordBatch.from_arrays([_signed(key.reshape(-1)), _signed(np.repeat(par[head], BANDS)), pa.array(np.repeat(many, BANDS))],
                                         names=["key", "par", "many"])


def _meet(batches):
    """Rows sorted by (key, par) stream by. Put out are: (key, par) of every
    paragraph in a key of several (near); those of the first band that may stand
    in several documents (exact); and for a key of more than GROUP paragraphs
    its number (size, without par). A key may span any number of batches: of
    it, only its latest paragraph and their number are kept."""
    names = ["key", "par", "near", "exact", "size"]

    def rows(key, par, many, number):
        near, exact = number > 1, many & (key & (BANDS - 1) == 0)
        some = near | exact
        key, par, near, exact = key[some], par[some], near[some], exact[some]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(par), pa.array(near), pa.array(exact), pa.nulls(len(key), pa.int64())],
                                         names=names)

    def large(key, size):
        some = size > GROUP
        none = pa.nulls(int(some.sum()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.nulls(len(none), pa.int64()), none, none,
                                          pa.array(size[some].astype(np.int64))], names=names)

    held, before = None, 0  # the last paragraph: (key, par, many); paragraphs of its key before it
    for batch in batches:
        if not batch.num_rows:
            continue
        key, par, many = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held:
            key, par, many = (np.append(h, x) for h, x in zip(held, (key, par, many), strict=True))
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (par[1:] != par[:-1])))
        many = np.logical_or.reduceat(many, head) | (np.diff(np.append(head, len(key))) > 1)  # of several batches
        key, par = key[head], par[head]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        number = np.repeat(size, size)
        size[0] += before
        number[:np.append(first, len(key))[1]] = size[0]
        yield from rows(key[:-1], par[:-1], many[:-1], number[:-1])
        yield from large(key[first[:-1]], size[:-1])
        held, before = (key[-1], par[-1], many[-1]), int(size[-1]) - 1
    if held:
        yield from rows(*(np.array([x]) for x in (*held, before + 1)))
        yield from large(np.array([held[0]]), np.array([before + 1]))


def _places(batches):
    """(par, doc, doc_id, at, end, upto, gap): every paragraph's hash and byte
    span, where the next one begins, and the hash of the words up to there."""
    for batch in batches:
        _, once = np.unique(batch.column(0).to_numpy(), return_index=True)  # repeated rows are one document
        for part in text_slices(batch if len(once) == batch.num_rows else batch.take(pa.array(np.sort(once))), 2):
            buf, off = text_bytes(part.column(2))
            row, lo, hi, starts, ends, h = cut(buf, off)
            if not len(row):
                continue
            first, sums = np.searchsorted(starts, off), _word_sums(h)
            upto = _gaps(row, lo, hi, first)
            beyond = np.where(upto < first[row + 1], np.append(starts, 0)[upto], ends[upto - 1])  # next paragraph, or the text's end
            take, base = pa.array(row), off[row]
            yield pa.RecordBatch.from_arrays(
                [_signed(_words_hash(sums, lo, hi)), part.column(0).take(take), part.column(1).take(take),
                 *(pa.array((x - base).astype(np.int32)) for x in (starts[lo], ends[hi - 1], np.maximum(beyond, ends[hi - 1]))),
                 _signed(_words_hash(sums, hi, upto))],
                names=["par", "doc", "doc_id", "at", "end", "upto", "gap"])


def _flat_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, and where each
    text's begin."""
    buf, off = text_bytes(col)
    starts, ends, first = word_spans(buf, off)
    sh = _shingles(word_hashes(buf, starts, ends))
    count = np.maximum(np.diff(first) - WIDTH + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    sh = sh[np.arange(len(row)) + np.repeat(first[:-1] - np.append(0, np.cumsum(count))[:-1], count)]
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.append(True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1]))[:len(sh)]
    return sh[new], np.append(0, np.cumsum(np.bincount(row[new], minlength=len(count))))


def _sets(col: pa.Array) -> list[np.ndarray]:
    """Distinct shingle hashes of each paragraph's text."""
    flat, at = _flat_sets(col)
    return [flat[a:b] for a, b in pairwise(at.tolist())]


def left_out(sets: list[np.ndarray]) -> list[tuple[int, int, bool]]:
    """(key, which, whole) of sets of at most twelve shingles: two of them have
    Jaccard 0.8 or more just if they share a key at which one of them is whole.

    Such sets differ by two shingles at most. A key is what is left of a set
    with none, one or two shingles left out; of eight or more, members with up
    to one left out are all within 0.8 of each other (each counts as whole);
    elsewhere only a set that is itself the key is within 0.8 of the others."""
    out = []
    for i, x in enumerate(sets):
        each = mix64(x)
        n, total = len(x), int(each.sum(dtype=U64))
        keys = [(0, total, n, True), (1, total, n, True)]
        one = [total - int(e) for e in each]
        keys += [(0, k, n - 1, True) if n - 1 >= 8 else (1, k, n - 1, False) for k in one if n - 1 >= 4]
        if n - 2 >= 8:
            keys += [(1, k - int(e), n - 2, False) for j, k in enumerate(one) for e in each[j + 1:]]
        out += [(k * 64 + size * 2 + kind, i, whole) for kind, k, size, whole in keys]
    return out


def _left_out_rows(batches):
    """(key, par, whole) from rows (par, body)."""
    for batch in batches:
        found = left_out(_sets(batch.column(1)))
        key = np.array([k % (1 << 64) for k, _, _ in found], U64)
        take = pa.array([i for _, i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([_signed(mix64(key)), batch.column(0).take(take), pa.array([w for _, _, w in found], pa.bool_())],
                                         names=["key", "par", "whole"])


def verified(sets: list[np.ndarray], least: float = JACCARD) -> list[tuple[int, int]]:
    """Index pairs that span the same components as all pairs of Jaccard
    ``least`` or more. Prefix filter: shingles ordered rarest first; such a
    pair shares one of its first |x| - ceil(least |x|) + 1 shingles."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both >= least * (len(sets[0]) + len(sets[1]) - both) else []
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    lists: dict[int, dict[int, list[int]]] = defaultdict(dict)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x = sets[i]
        at = np.searchsorted(values, x)
        rare = x[np.lexsort((x, counts[at]))][:len(x) - int(np.ceil(least * len(x))) + 1].tolist()
        tried = set()
        for s in rare:
            groups: dict[int, list[int]] = {}  # by component: one link to it is enough
            for root, members in lists[s].items():
                if find(root) != find(i):
                    for j in members:
                        if j in tried:
                            continue
                        tried.add(j)
                        both = len(np.intersect1d(x, sets[j], assume_unique=True))
                        if both >= least * (len(x) + len(sets[j]) - both):
                            parent[find(i)] = find(j)
                            out.append((i, j))
                            break
                known = groups.setdefault(find(root), members)
                if known is not members:
                    known.extend(members)
            groups.setdefault(find(i), []).append(i)
            lists[s] = groups
    return out


def _close_pairs(flat: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the sets first[i] and first[i] + 1, whether they reach JACCARD."""
    size = at[first + 2] - at[first]
    pair = np.repeat(np.arange(len(first)), size)
    both = flat[np.arange(len(pair)) + np.repeat(at[first] - np.append(0, np.cumsum(size))[:-1], size)]
    order = np.lexsort((both, pair))
    both = both[order]  # pairs stay where they are
    shared = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(first))
    return (size > 0) & (shared >= JACCARD * (size - shared))


def _verify(batches):
    for batch in runs(batches):
        key, par = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        flat, at = _flat_sets(batch.column(2))
        edges = np.append(0, np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)))
        two = edges[:-1][np.diff(edges) == 2]
        two = two[_close_pairs(flat, at, two)] if len(two) else two
        more = np.flatnonzero(np.diff(edges) > 2)
        pairs = [(lo + i, lo + j) for lo, hi in zip(edges[more].tolist(), edges[more + 1].tolist(), strict=True)
                 for i, j in verified([flat[at[r]:at[r + 1]] for r in range(lo, hi)])]
        left, right = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
        yield pa.RecordBatch.from_arrays([pa.array(par[np.append(two, left)]), pa.array(par[np.append(two + 1, right)])], names=["a", "b"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written: (doc, doc_id, at, end, reach, par, root, head, head_id, keep,
    same), the byte span of every paragraph whose class is found in several
    documents; head: the first of them; keep: whether this is it; same: whether
    it has the equal paragraph; reach: the end, or where the next paragraph
    begins if the words up to there are the head's. doc is the hash of
    (doc_id, text)."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = _paragraph_rows(docs, doc_id, text)
    met = materialize(in_arrow(in_arrow(rows, _band_rows, "key long, par long, many boolean")
                          .repartition(n, "key").sortWithinPartitions("key", "par"), _meet,
                               "key long, par long, near boolean, exact boolean, size long"))
    # written, so that the join may split a paragraph that stands everywhere
    wanted = materialize(met.where("par is not null").select(F.col("par").alias("w_par")).distinct())
    places = in_arrow(rows, _places, "par long, doc long, doc_id long, at int, end int, upto int, gap long")
    places = materialize(places.join(wanted, places["par"] == wanted["w_par"], "left_semi"))

    # one text of every paragraph that met different ones
    near = met.where("near").select(F.col("par").alias("n_par")).distinct()
    spot = F.min(F.struct("doc", "at", "end")).alias("spot")
    one = places.groupBy("par").agg(spot).join(near, F.col("par") == F.col("n_par"), "left_semi") \
        .select("par", "spot.doc", "spot.at", "spot.end")
    texts = rows.select(F.col("doc").alias("t_doc"), F.col("text").cast("binary").alias("t_text"))
    bodies = materialize(texts.join(one, texts["t_doc"] == one["doc"])
                              .select(F.col("par").alias("b_par"), F.substring(
                                  "t_text", F.col("at") + 1, F.col("end") - F.col("at")).cast("string").alias("body"))
                              .dropDuplicates(["b_par"]), "zstd")
    large = met.where("size is not null").select(F.col("key").alias("l_key"))  # one row in GROUP at most
    groups = met.where("near").select("key", "par").join(large, F.col("key") == F.col("l_key"), "left")
    pairs = groups.where("l_key is null").select("key", "par").join(bodies, F.col("par") == F.col("b_par")).select("key", "par", "body")
    edges = in_arrow(pairs.repartition(n, "key").sortWithinPartitions("key"), _verify, "a long, b long")
    hot = groups.where("l_key is not null").select("par").distinct().join(bodies, F.col("par") == F.col("b_par"))
    keys = materialize(in_arrow(hot.select("par", "body"), _left_out_rows, "key long, par long, whole boolean"))
    least = (keys.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("par"))).alias("b"), F.min("par").alias("lo"), F.max("par").alias("hi"))
                 .where("b is not null and lo <> hi").select(F.col("key").alias("k_key"), "b"))
    linked = keys.join(least, F.col("key") == F.col("k_key")).select(F.col("par").alias("a"), "b").where("a <> b")
    roots = components(edges.union(linked))
    discard(bodies, keys, met, wanted)
    # of every class of several documents the first; joined back by paragraph
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "at", "gap")).alias("head")
    pars = places.groupBy("par").agg(head, F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    pars = materialize(pars.join(roots, pars["par"] == roots["node"], "left").select("par", F.coalesce("root", "par").alias("root"), "head", "lo", "hi"))
    shared = (pars.groupBy("root").agg(F.min("head").alias("head"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
                  .select(F.col("root").alias("s_root"), F.col("head.doc").alias("head"), F.col("head.doc_id").alias("head_id")))
    classed = pars.select(F.col("par").alias("c_par"), "root", F.col("head.doc").alias("p_head"), F.col("head.gap").alias("p_gap")) \
        .join(shared, F.col("root") == F.col("s_root"))
    same = F.col("p_head") == F.col("head")
    found = materialize(places.join(classed, F.col("par") == F.col("c_par")).select(
        "doc", "doc_id", "at", "end", F.when(same & (F.col("gap") == F.col("p_gap")), F.col("upto")).otherwise(F.col("end")).alias("reach"),
        "par", "root", "head", "head_id", (F.col("doc") == F.col("head")).alias("keep"), same.alias("same")))
    discard(places, pars)
    return found


def _firsts(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of rows in this order (by group), the first of each group."""
    g = group[order]
    return order[np.append(True, g[1:] != g[:-1])[:len(g)]]


def _ends(batches):
    """From rows (doc, at, end, reach, head, root, par, same) of cut paragraphs
    in order of doc and at: (doc, root, par, pos, right, most). Of each merged
    run and each of its keepers, where the first paragraph begins and the last
    ends; if the keeper has no equal one, also where the next does of which it
    has. most: bytes up to the keeper's next run and a little more, or null."""
    for batch in runs(batches):
        doc, at, end, reach, head, root, par, same = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        number = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 32
        upto = np.maximum.accumulate(number + reach)  # a later document has larger values
        run = np.cumsum(np.append(True, (number + at)[1:] > upto[:-1])) - 1
        begins = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        run_from, run_to, run_doc = at[begins], upto[np.append(begins[1:], len(run)) - 1] & 0xFFFFFFFF, number[begins]
        heads, keeper = np.unique(head, return_inverse=True)
        group = run * len(heads) + keeper
        known = np.unique(group)
        out = []
        for right, place in ((False, at), (True, -end.astype(np.int64))):
            order = np.lexsort((place, group))
            first = _firsts(order, group)
            equal = _firsts(order[same[order]], group)
            first = np.append(first, equal[np.isin(group[equal], group[first[~same[first]]])])
            other = run[first] + (1 if right else -1)  # a neighbour of the same keeper grows on by itself
            there = (other >= 0) & (other < len(begins)) & np.isin(other * len(heads) + keeper[first], known)
            other = np.clip(other, 0, len(begins) - 1)
            there &= run_doc[other] == number[first]
            pos = (end if right else at)[first]
            most = (run_from[other] - pos if right else pos - run_to[other]) + MEET
            some = pos > 0
            out.append([x[some] for x in (doc[first], root[first], par[first], pos, np.full(len(first), right), most, there)])
        doc, root, par, pos, right, most, there = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (doc, root, par, pos, right)), pa.array(most.astype(np.int32), mask=~there)],
                                         names=["doc", "root", "par", "pos", "right", "most"])


def words_before(raw: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, word) of the words that end at ``at`` or before, nearest first."""
    while True:
        while at and raw[at - 1] in b" \t\n\v\f\r":
            at -= 1
        if not at:
            return
        end = at
        while at and raw[at - 1] not in b" \t\n\v\f\r":
            at -= 1
        yield at, raw[at:end]


def words_after(raw: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(end, word) of the words from ``at`` on."""
    return ((m.end(), m.group()) for m in _WORD.finditer(raw, at))


def _contexts(batches):
    """(k_doc, k_pos, k_right, words): up to CONTEXT words (of about k_most
    bytes) before or after the places in the keepers' texts, nearest first."""
    for batch in batches:
        rows = []
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for p in places:
                words, left = [], p["k_most"]
                for _, w in islice((words_after if p["k_right"] else words_before)(raw, p["k_pos"]), CONTEXT):
                    words.append(w)
                    left -= len(w) + 1
                    if left < 0:
                        break
                rows.append((doc, p["k_pos"], p["k_right"], b" ".join(words).decode()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.bool_(), pa.string()], strict=True)],
                                         names=["k_doc", "k_pos", "k_right", "words"])


def _grown(raw: bytes, pos: int, right: bool, words: str) -> tuple[int, int]:
    """The span next to ``pos`` whose words agree with ``words``."""
    at = pos
    for (place, own), other in zip((words_after if right else words_before)(raw, pos), words.encode().split(),
                                   strict=False):
        if own != other:
            break
        at = place
    return (pos, at) if right else (at, pos)


def _without(texts: pa.Array, spans: pa.Array, ends: pa.Array) -> tuple[pa.Array, list[int], list[int]]:
    """Texts without their merged spans, grown at their ends; the words and the
    passages cut out of each. Rows without spans stay as they are."""
    hit = pc.greater(pc.fill_null(pc.list_value_length(spans), 0), 0)
    some = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
    out, cut_words, cut_spans = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at_rows = pa.array(some)
    for i, body, own, grow in zip(some.tolist(), *(c.take(at_rows).to_pylist() for c in (texts, spans, ends)), strict=True):
        raw, at, kept, words, merged = body.encode(), 0, [], 0, 0
        for lo, hi in sorted([(x["at"], x["end"]) for x in own]
                             + [_grown(raw, e["pos"], e["right"], e["words"]) for e in grow or []]):
            merged += lo > at or not at
            kept.append(raw[at:max(at, lo)])
            words += len(raw[max(at, lo):max(at, hi)].split())
            at = max(at, hi)
        kept.append(raw[at:])
        out.append(b"".join(kept).decode())
        cut_words[i], cut_spans[i] = words, merged
    return (pc.replace_with_mask(texts, hit, pa.array(out, texts.type)) if len(some) else texts), cut_words, cut_spans


def ends(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, right, words): where cut paragraphs begin or end, the keeper's
    words beyond; of ``repeats`` found. A keeper's place is that of the equal
    paragraph, else of the first of the class."""
    cuts = found.where("not keep").select("doc", "at", "end", "reach", "head", "root", "par", "same")
    cuts = cuts.repartition(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc", "at")
    wanted = materialize(in_arrow(cuts, _ends, "doc long, root long, par long, pos int, right boolean, most int"))
    kept = found.where("keep").select("root", "par", F.struct("doc", "at", "end").alias("place"))
    equal = kept.groupBy(F.col("root").alias("e_root"), F.col("par").alias("e_par")).agg(F.min("place").alias("equal"))
    first = kept.groupBy(F.col("root").alias("f_root")).agg(F.min("place").alias("first"))
    pars = wanted.select("root", "par").distinct()
    pars = (pars.join(equal, (F.col("root") == F.col("e_root")) & (F.col("par") == F.col("e_par")), "left")
                .join(first, F.col("root") == F.col("f_root"))
                .select(F.col("root").alias("p_root"), F.col("par").alias("p_par"),
                        F.coalesce("equal", "first").alias("place")))
    most = F.coalesce("most", F.lit((1 << 31) - 1))
    at = (wanted.join(pars, (F.col("root") == F.col("p_root")) & (F.col("par") == F.col("p_par")))
                .select("doc", "pos", "right", most.alias("most"), F.col("place.doc").alias("w_doc"),
                        F.when(F.col("right"), F.col("place.end")).otherwise(F.col("place.at")).alias("w_pos")))
    at = materialize(at)
    keepers = (at.groupBy("w_doc", F.col("w_pos").alias("k_pos"), F.col("right").alias("k_right")).agg(F.max("most").alias("k_most"))
                 .groupBy(F.col("w_doc").alias("k_doc")).agg(F.collect_list(F.struct("k_pos", "k_right", "k_most")).alias("places")))
    texts = _paragraph_rows(docs, doc_id, text)
    contexts = in_arrow(texts.join(keepers, texts["doc"] == keepers["k_doc"]).select("k_doc", "text", "places"),
                        _contexts, "k_doc long, k_pos int, k_right boolean, words string") \
        .where("words <> ''").dropDuplicates(["k_doc", "k_pos", "k_right"])
    return (at.join(contexts, (F.col("w_doc") == F.col("k_doc")) & (F.col("w_pos") == F.col("k_pos"))
                    & (F.col("right") == F.col("k_right")))
              .select("doc", "pos", "right", F.substring("words", F.lit(1), F.col("most")).alias("words")))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated paragraphs cut out of ``text``, and new columns
    ``cut_words``, ``cut_passages`` and ``cut_first_ids`` (the ids of the
    documents that keep what was cut, distinct and sorted)."""
    found = repeats(docs, doc_id, text)
    cuts = found.where("not keep").select("doc", F.struct("at", F.col("reach").alias("end")).alias("span"), "head_id",
                                          F.lit(None).cast("struct<pos:int,right:boolean,words:string>").alias("grow"))
    grow = ends(found, docs, doc_id, text).select(
        "doc", F.lit(None).cast("struct<at:int,end:int>").alias("span"), F.lit(None).cast("long").alias("head_id"),
        F.struct("pos", "right", "words").alias("grow"))
    r_doc, r_spans, r_ends, r_ids, key = (fresh(docs, c) for c in ("r_doc", "r_spans", "r_ends", "r_ids", "r_key"))
    spans = cuts.unionByName(grow).groupBy(F.col("doc").alias(r_doc)).agg(
        F.collect_set("span").alias(r_spans), F.collect_set("grow").alias(r_ends),
        F.array_sort(F.collect_set("head_id")).alias(r_ids))
    rows = docs.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    rows = rows.join(spans, rows[key] == spans[r_doc], "left")
    names, at = docs.columns, docs.columns.index(text)
    extra = [fresh(docs, c) for c in ("cut_words", "cut_passages", "cut_first_ids")]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, 16 << 20):
                cols = list(part.columns[:len(names)])
                cols[at], words, merged = _without(cols[at], *part.columns[len(names):len(names) + 2])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words), pa.array(merged), part.column(len(names) + 2)],
                                                 names=[*names, *extra])

    schema = T.StructType([*docs.schema.fields, T.StructField(extra[0], T.LongType()),
                           T.StructField(extra[1], T.LongType()), T.StructField(extra[2], T.ArrayType(T.LongType()))])
    ids = F.coalesce(r_ids, F.array().cast("array<bigint>"))
    return in_arrow(rows.select(*names, F.col(r_spans), F.col(r_ends), ids.alias(r_ids)), run, schema)

