"""Language ID by word-first backoff.

Known words are scored by their log frequency in each language; a word the
model does not know is scored by its character n-grams, longest order first:
the first order of which the model knows any gram decides, else shorter ones
follow. Counts cover every training row, and the model has every word and gram
that was counted, whatever its language and frequency. They are tables in the
checkpoint folder; a worker reads them once and keeps a 64-bit hash and one
float per language of each key, and the driver keeps none.

Texts that are null or have no letter are ``und`` with score 0; so is every
text if nothing was learned. Rows without text or language teach nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (TokenRows, fresh, in_arrow, materialize, open_store, text_bytes, text_slices, tokens,
                     word_hashes)

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDER = 4


def words_of(token: str) -> list[str]:
    if token.isalpha():
        return [token]
    bare = token.strip(".,;:!?")
    return [bare] if bare.isalpha() else _WORD.findall(token)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    padded = f"^{word}$"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)] if len(padded) >= n else []


def _word_counts(batches):
    for batch in batches:
        rows: Counter = Counter()
        for part in text_slices(batch, 0, 16 << 20):
            found, codes, ends = tokens(part.column(0))
            lang = part.column(1).dictionary_encode()
            key = np.repeat(lang.indices.to_numpy(), np.diff(ends)).astype(np.int64) * len(found) + codes
            key, counts = np.unique(key, return_counts=True)
            names = lang.dictionary.to_pylist()
            for which, at, n in zip((key // len(found)).tolist(), (key % len(found)).tolist(), counts.tolist(),
                                    strict=True):
                token = found[at].lower()
                for word in words_of(token):
                    rows[names[which], word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
             pa.array(list(rows.values()), pa.int64())], names=["lang", "word", "n"])


def _gram_counts(batches):
    for batch in batches:
        rows: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for order in range(1, ORDER + 1):
                for gram in grams(word, order):
                    rows[lang, gram] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
             pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])


def _hashes(keys: pa.Array) -> np.ndarray:
    buf, off = text_bytes(keys)
    return word_hashes(buf, off[:-1], off[1:])


class Table:
    """Log frequencies in each language of all keys (and counts) in ``files``."""

    def __init__(self, files: list[str], totals: np.ndarray):
        self.files, self.totals = files, totals
        self.hashes: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"hashes": None, "logs": None}

    def load(self) -> None:
        stores = [open_store(uri) for uri in self.files]
        n = 0
        for fs, path in stores:
            with fs.open_input_file(path) as f:
                n += pq.ParquetFile(f).metadata.num_rows
        # filled and ordered in place: a worker never holds the model twice
        hashes, logs, end = np.empty(n, np.uint64), np.empty((n, len(self.totals)), np.float32), 0
        for fs, path in stores:
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches():
                    counts = batch.column(1).flatten().to_numpy().reshape(-1, len(self.totals))
                    here = slice(end, end := end + len(batch))
                    hashes[here] = _hashes(batch.column(0))
                    # never met: half a count of the language of most, so that a rare word of a large
                    # language is no evidence for a small one
                    logs[here] = np.log(counts / self.totals + 0.5 / self.totals.max())
        # stable: of keys with one hash the first is found
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        del hashes
        for column in logs.T:
            column[:] = column[order]
        self.logs = logs
        pa.default_memory_pool().release_unused()

    def at(self, keys: list[str]) -> np.ndarray:
        """Row of ``logs`` of each key, -1 if it was never counted."""
        if self.hashes is None:
            self.load()
        if not len(self.hashes) or not keys:
            return np.full(len(keys), -1)
        own = _hashes(pa.array(keys, pa.large_string()))
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, at, -1)


class Model:
    """Words, grams and languages of a fitted model."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams
        self.rows: TokenRows | None = None

    def __getstate__(self):
        return self.__dict__ | {"rows": None}

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean logs of the longest grams of each word that the model knows."""
        logs, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for order in range(ORDER, 0, -1):
            made = [grams(words[i], order) for i in left.tolist()]
            word = np.repeat(left, [len(g) for g in made])
            at = self.grams.at([g for gs in made for g in gs])
            word, at = word[at >= 0], at[at >= 0]
            if len(word):
                found, first, many = np.unique(word, return_index=True, return_counts=True)
                logs[found] = np.add.reduceat(self.grams.logs[at], first, axis=0) / many[:, None]
                left = np.setdiff1d(left, found, assume_unique=True)
        return logs

    def tokens(self, made: list[str]) -> np.ndarray:
        """Summed logs of the words in each blank-separated token, and their number."""
        words = [words_of(token.lower()) for token in made]
        count = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        at = self.words.at(flat)
        logs = np.zeros((len(flat), len(self.langs)))
        logs[at >= 0] = self.words.logs[at[at >= 0]]
        if (at < 0).any():
            logs[at < 0] = self.unseen([flat[i] for i in np.flatnonzero(at < 0).tolist()])
        out = np.zeros((len(made), len(self.langs) + 1))
        out[:, -1] = count
        some = count > 0
        if some.any():
            out[some, :-1] = np.add.reduceat(logs, (np.cumsum(count) - count)[some], axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_all(pa.array([text], pa.string()))
        return langs[0], float(scores[0])

    def predict_all(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a string column."""
        if not self.langs or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        if self.rows is None:
            self.rows = TokenRows(len(self.langs) + 1, make_all=self.tokens)
        found, codes, ends = tokens(texts)
        total = np.add.reduceat(self.rows(found)[codes], ends[:-1], axis=0)
        logs, n = total[:, :-1], total[:, -1]
        # the evidence of twenty words at most
        p = np.exp((logs - logs.max(1, keepdims=True)) * np.minimum(1.0, 20 / np.maximum(n, 1))[:, None])
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)  # ties: first language by name
        some = n > 0
        return ([self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)],
                np.where(some, p[np.arange(len(p)), best], 0.0))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    # languages are summed inside each word, so one word is one row
    words = materialize(in_arrow(rows, _word_counts, "lang string, word string, n long")
                            .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    counted = in_arrow(words, _gram_counts, "lang string, gram string, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()

    names = [r["lang"] for r in langs]

    def whole(table: DataFrame, key: str, totals: list) -> Table:
        """All keys, with one count per language."""
        by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
        rows = materialize(table.groupBy(key).agg(by.alias("by")).select(
            key, F.array(*[F.coalesce(F.col("by")[x], F.lit(0)) for x in names]).alias("n")))
        n = {r["lang"]: r["n"] for r in totals}
        return Table(rows.inputFiles(), np.array([n.get(x, 0) for x in names], float))

    if not names:
        return Model([], Table([], np.zeros(0)), Table([], np.zeros(0)))
    return Model(names, whole(words, "word", langs), whole(counted, "gram", totals))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # names of files, not their rows
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_slices(batch, at):
                langs, scores = m.predict_all(part.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names, pred, score])

    fields = [*docs.schema.fields]
    from pyspark.sql import types as T
    return in_arrow(docs, run, T.StructType([*fields, T.StructField(pred, T.StringType()),
                                              T.StructField(score, T.DoubleType())]))


def held_out(crc: Column, of: int, remainder: int) -> Column:
    return F.coalesce(crc % of == remainder, F.lit(False))
