"""n-grams of the rows of an Arrow batch, counted with numpy inside tasks.

An n-gram is the pair (the n-gram before its last token, its last token); the
pairs of a slice of rows are numbered order by order, so a gram is an integer
until it is named, and only distinct grams of a slice become strings. n-grams
never cross sequences, and a slice never cuts a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20          # tokens (of whole rows) handled at a time
# whitespace runs of the char analyser (Java's \s, as functions.text.collapse_double_space)
_RUNS = r"[ \t\n\x0B\f\r][ \t\n\x0B\f\r]+"


def compact(key: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (0 to ``space`` - 1) and each key's place in them."""
    if space > max(8 * len(key), 1 << 16):
        return np.unique(key, return_inverse=True)
    seen = np.zeros(space, bool)
    seen[key] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32 if space < 1 << 31 else np.int64) - 1)[key]


def tally(row: np.ndarray, gram: np.ndarray, rows: int, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, times) of the distinct pairs, sorted; rows from 0 to ``rows`` - 1,
    grams from 0 to ``names`` - 1. Short keys sort in half the time."""
    kind = np.uint32 if rows * names < 1 << 32 else np.int64
    key = row.astype(kind)
    key *= kind(names)
    key += gram.astype(kind)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    row, gram = np.divmod(key[first], kind(names))
    return row.astype(np.int64), gram.astype(np.int64), np.diff(np.append(first, len(key)))


def gram_levels(ids: np.ndarray, seq: np.ndarray, vocab: pa.Array, lo: int, hi: int, sep: str):
    """(n, positions, grams, names, ahead) for n = lo..hi: n-gram ``names[grams[i]]``
    ends at token ``positions[i]``. ``ids`` index ``vocab``; ``seq`` is the
    sequence of each token (equal values lie together). ``ahead``: the last but one
    token of each name (a unigram's own)."""
    names, gram, at = vocab, ids, np.arange(len(ids))
    last = ahead = np.arange(len(vocab))
    for n in range(1, hi + 1):
        if n > 1:
            at = np.flatnonzero(seq[n - 1:] == seq[:max(len(seq) - n + 1, 0)]) + n - 1
            space = len(names) * len(vocab)
            found, made = compact(gram[at - 1].astype(np.int32 if space < 1 << 31 else np.int64) * len(vocab) + ids[at], space)
            names = pc.binary_join_element_wise(names.take(pa.array(found // max(len(vocab), 1))),
                                                vocab.take(pa.array(found % max(len(vocab), 1))), pa.scalar(sep, pa.large_string()))
            gram = np.full(len(ids), -1, made.dtype)
            gram[at] = made
            ahead, last = last[found // max(len(vocab), 1)], found % max(len(vocab), 1)
        if n >= lo:
            yield n, at, gram[at], names, ahead


def slices(lengths: np.ndarray):
    """(first, last + 1) row of runs of at most ``SLICE`` tokens (or one row)."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield lo, hi
        lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def char_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(length of each text, ids, vocabulary): its code points."""
    points = _points(texts)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    if (blank[1:] & blank[:-1]).any():
        texts = pc.replace_substring_regex(texts, _RUNS, " ")
        points = _points(texts)
    found, ids = compact(points, int(points.max(initial=0)) + 1)
    return (pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), ids,
            pa.array([chr(c) for c in found.tolist()], pa.large_string()))


def _points(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)


def list_ids(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ids and vocabulary of a flat token array."""
    coded = tokens.cast(pa.large_string()).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, ids, vocabulary): what lies between single
    blanks, empty words too."""
    lengths, words = flat(pc.split_pattern(texts, " "))
    return lengths, *list_ids(words)


def tokenise(texts: pa.Array, unit: str):
    return word_ids(texts) if unit == "w" else char_ids(texts)


def row_terms(rows: pa.Array, unit: str, lo: int, hi: int):
    """Terms of rows that are lists of texts: (n, row, term, tf, names) slice by
    slice, sorted by row; term i is called ``names[i]``. The longest n-grams come
    first: those of a slice are sorted once, shorter ones are their beginnings."""
    many, texts = flat(rows)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(many)])
    sums = np.concatenate([[0], np.cumsum(size)])[cuts]
    for a, b in slices(np.diff(sums)):
        lengths, ids, vocab = tokenise(texts.slice(cuts[a], cuts[b] - cuts[a]), unit)
        if not len(ids):
            continue
        levels = beginnings(ids, lengths, vocab, hi, " " if unit == "w" else "")
        ends = np.concatenate([[0], np.cumsum(lengths)])
        row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[cuts[a:b + 1] - cuts[a]]))
        gram, names, shorter, whole = levels[-1]
        row, gram, tf = tally(row, gram, b - a, len(names) if whole is None else len(whole))
        for n in range(hi, lo - 1, -1):
            _, names, shorter, whole = levels[n - 1]
            if whole is None:
                yield n, (a, b), row + a, gram, tf, names
            else:
                # n-grams that the end of a text cuts off have no name
                mine = whole[gram]
                if mine.any():
                    place = np.cumsum(whole) - 1
                    yield n, (a, b), row[mine] + a, place[gram[mine]], tf[mine], names
            if n > lo:
                gram = shorter[gram]
                first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])))
                row, gram, tf = row[first], gram[first], np.add.reduceat(tf, first)


def beginnings(ids: np.ndarray, lengths: np.ndarray, vocab: pa.Array, hi: int, sep: str) -> list[tuple]:
    """(gram, names, shorter, whole) for n = 1..hi: the n-gram that begins at each
    token, in an order in which n-grams of equal beginnings lie together; the
    number of its beginning of n - 1 tokens; and which of them are whole (None: all),
    as the end of a text cuts some off. ``names`` has the whole ones in order."""
    gram, every = ids.astype(np.int32), len(vocab)
    levels = [(gram, vocab, None, None)]
    left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))).astype(np.int32)
    named = np.arange(every)          # where a gram of the order below is in its names
    for n in range(2, hi + 1):
        space = every * (len(vocab) + 1)
        key = gram.astype(np.int32 if space < 1 << 31 else np.int64)
        key *= len(vocab) + 1
        key[:1 - n] += np.where(left[:1 - n] >= n, ids[n - 1:] + 1, 0).astype(key.dtype)
        found, gram = compact(key, space)
        shorter, last = np.divmod(found, len(vocab) + 1)
        whole = last > 0
        names = pc.binary_join_element_wise(levels[-1][1].take(pa.array(named[shorter[whole]])), vocab.take(pa.array(last[whole] - 1)),
                                            pa.scalar(sep, pa.large_string()))
        levels.append((gram, names, shorter, whole))
        named, every = np.cumsum(whole) - 1, len(found)
    return levels


def wrapped(tokens: pa.Array, bos: str, eos: str):
    """Token lists wrapped in ``bos`` and ``eos``, by slices: (first and last + 1 row,
    ids, row of each token, its place in the row, vocabulary)."""
    lengths, values = flat(tokens)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    ends = pa.array([bos, eos], pa.large_string())
    for a, b in slices(lengths + 2):
        inner, vocab = list_ids(values.slice(cuts[a], cuts[b] - cuts[a]))
        size = lengths[a:b] + 2
        first = np.cumsum(size) - size
        last = first + size - 1
        ids = np.zeros(int(size.sum()), np.int64)
        middle = np.ones(len(ids), bool)
        middle[first], middle[last] = False, False
        # tokens written as the markers are are the same tokens
        vocab, again = list_ids(pa.concat_arrays([ends, vocab]))[::-1]
        ids[first], ids[last], ids[middle] = again[0], again[1], again[2:][inner]
        yield (a, b), ids, np.repeat(np.arange(a, b), size), np.arange(len(ids)) - np.repeat(first, size), vocab


def sequence_grams(tokens: pa.Array, order: int, bos: str, eos: str, sep: str):
    """n-grams (n = 1..order) of token lists wrapped in ``bos`` and ``eos``, by
    slices: (n, row, whether it ends at ``bos``, gram, names, (ahead, vocabulary))."""
    for _, ids, seq, place, vocab in wrapped(tokens, bos, eos):
        for n, at, gram, names, ahead in gram_levels(ids, seq, vocab, 1, order, sep):
            if len(at):
                yield n, seq[at], place[at] == 0, gram, names, (ahead, vocab)


def distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers (0 to its size - 1 each), sorted, and how
    often each is there: one key a row, numbered anew where it would not fit."""
    key, space, steps = columns[0].astype(np.int64), sizes[0], []
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if space * size >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            steps.append((0, found))
            space = len(found)
        key = key * size + column
        space *= size
        steps.append((size, None))
    key, times = np.unique(key, return_counts=True)
    out = []
    for size, found in reversed(steps):
        if size:
            key, last = np.divmod(key, size)
            out.append(last)
        else:
            key = found[key]
    return [key, *reversed(out)], times


def sequence_windows(tokens: pa.Array, group: np.ndarray, order: int, bos: str, eos: str, sep: str):
    """The n-grams of ``order`` tokens (fewer from ``bos`` on) that end at each token
    but ``bos``; all shorter n-grams are their ends. By slices, distinct for each group
    of rows: (group, names, times, last but one token, vocabulary)."""
    groups = int(group.max(initial=-1)) + 1
    for _, ids, seq, place, vocab in wrapped(tokens, bos, eos):
        end = np.flatnonzero(place > 0)
        back = [np.where(place[end] >= k, ids[np.maximum(end - k, 0)], len(vocab)) for k in range(order)]
        (which, *back), times = distinct([group[seq[end]], *back], [groups, *[len(vocab) + 1] * order])
        laid = np.stack(back[::-1], axis=1)
        there = laid < len(vocab)
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int64())
        names = pc.binary_join(pa.LargeListArray.from_arrays(offsets, vocab.take(pa.array(laid[there]))), pa.scalar(sep, pa.large_string()))
        yield which, names, times, back[min(1, order - 1)], vocab
