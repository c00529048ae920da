"""TF-IDF with smoothed IDF and per-block L2 row normalisation.

idf(t) = ln((1 + n) / (1 + df(t))) + 1, value = tf * idf / ||tf * idf||_2,
where n counts the fitting documents and df the documents containing t.
The fitted vocabulary is a table (term, df, idf); terms outside it are
dropped at transform time.

Physical shape: rows are dealt into blocks (``text_blocks``), a block asks for
each of its distinct terms once (``block_terms``), and values are formed inside
the block (``additive`` has the reasons). The long table (row, term) exists
only where a caller wants it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..session import materialize
from .additive import add_up, block_of, flat_model
from .ngrams import term_counts
from .rowgrams import compact, row_terms

LONG_TEXT = 1 << 12      # characters of a row that is a block of its own


def fit_idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """Vocabulary table from fitting-set term counts. df is a count of
    (doc, term) rows per term, combined map-side, so a term present in every
    document is not a hot task."""
    return _with_idf(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def _with_idf(terms: DataFrame, n_docs: int) -> DataFrame:
    return terms.withColumn("idf", F.ln((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def tfidf_values(tf: DataFrame, vocab: DataFrame, keys: list[str], block: str,
                 normalize: bool = True) -> DataFrame:
    """(keys, feature, value) for one block; feature = ``block:term``."""
    v = vocab.select("term", "idf")
    w = (tf.join(v, on="term", how="inner")
           .withColumn("_w", F.col("tf") * F.col("idf")))
    if normalize:
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
        w = w.withColumn("_w", F.col("_w") / norm)
    return w.select(*keys, F.concat(F.lit(block + ":"), F.col("term")).alias("feature"),
                    F.col("_w").alias("value"))


def tfidf_block(df: DataFrame, keys: list[str], terms: Column, vocab: DataFrame,
                block: str) -> DataFrame:
    return tfidf_values(term_counts(df, keys, terms), vocab, keys, block)


# --- by blocks of rows ------------------------------------------------------

def row_texts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, texts): rows of equal keys are one row (one, as a rule)."""
    return df.groupBy(*keys).agg(F.collect_list(text_col).alias("texts"))


def text_blocks(df: DataFrame, keys: list[str], text_col: str, width: int = 1, near: str | None = None) -> DataFrame:
    """(keys, texts, _block), written once. ``near``: rows of equal values of
    this column share blocks where they can."""
    rows = row_texts(df, keys, text_col)
    if near:
        rows = rows.sortWithinPartitions(near)
    long = F.aggregate("texts", F.lit(0), lambda n, t: n + F.length(t)) > LONG_TEXT
    return materialize(block_of(rows, width, long))


def _terms_of(rows: pa.Table, kinds: dict):
    """(first and last + 1 row, row, feature number, tf, feature names) by slices
    that hold whole rows, all orders of a kind together; rows come once for each order."""
    texts = rows["texts"].combine_chunks()
    for name, (lo, hi) in kinds.items():
        part, span = [], None
        for n, now, row, term, tf, names in row_terms(texts, name, lo, hi):
            if part and now != span:
                yield name, *_joined(part)
                part = []
            part.append((row, term, tf, names))
            span = now
        if part:
            yield name, *_joined(part)


def _joined(part: list):
    sizes = np.cumsum([0, *(len(p[3]) for p in part)])
    row, term, tf = (np.concatenate(x) for x in ([p[0] for p in part], [p[1] + s for p, s in zip(part, sizes)], [p[2] for p in part]))
    return row, term, tf, pa.concat_arrays([p[3] for p in part])


def _prefixed(kind: str, names: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(kind, pa.large_string()), names, pa.scalar(":", pa.large_string()))


def block_terms(blocked: DataFrame, kinds: dict) -> DataFrame:
    """(_by, feature, df): the distinct features of each block and how many of
    its rows have them. ``kinds``: ``w`` (words) or ``c`` (characters) to the
    shortest and longest n-gram."""
    def terms(rows: pa.Table) -> pa.Table:
        names, df = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)]
        for kind, _, term, _, found in _terms_of(rows, kinds):
            names.append(_prefixed(kind, found))
            df.append(np.bincount(term, minlength=len(found)))
        got = pa.table([pa.concat_arrays(names), pa.array(np.concatenate(df))], ["feature", "df"])
        got = got.group_by("feature", use_threads=False).aggregate([("df", "sum")])
        return pa.table([pa.array(np.full(len(got), rows["_block"][0].as_py())), got["feature"].cast(pa.string()), got["df_sum"]],
                        ["_by", "feature", "df"])
    schema = StructType([StructField("_by", LongType()), StructField("feature", StringType()), StructField("df", LongType())])
    return blocked.select("_block", "texts").groupBy("_block").applyInArrow(terms, schema)


def vocabulary(asked: DataFrame, kind: str, n_docs: int) -> DataFrame:
    """(term, df, idf) of one kind from the blocks' terms."""
    mine = asked.where(F.col("feature").startswith(kind + ":"))
    return _with_idf(mine.groupBy(F.substr("feature", F.lit(len(kind) + 2)).alias("term")).agg(F.sum("df").alias("df")), n_docs)


def known(asked: DataFrame, vocabs: dict) -> DataFrame:
    """(_by, feature, idf) of the terms that the vocabularies have."""
    every = None
    for kind, v in vocabs.items():
        part = v.select(F.concat(F.lit(kind + ":"), F.col("term")).alias("feature"), "idf")
        every = part if every is None else every.unionByName(part)
    return asked.select("_by", "feature").join(every, "feature")


def _values(rows: pa.Table, found: pa.Table, kinds: dict):
    """(kind, row, place in ``found``, value) of the known terms, by slices."""
    names = found["feature"].combine_chunks().cast(pa.large_string())
    idf = found["idf"].to_numpy()
    for kind, row, term, tf, mine in _terms_of(rows, kinds):
        at = pc.index_in(_prefixed(kind, mine), names).fill_null(-1).to_numpy()[term].astype(np.int64)
        row, at, tf = row[at >= 0], at[at >= 0], tf[at >= 0]
        if len(at):
            w = tf * idf[at]
            yield row, at, w / np.sqrt(np.bincount(row, w * w))[row]


def _cogrouped(blocked: DataFrame, found: DataFrame):
    return blocked.groupBy("_block").cogroup(found.groupBy("_by"))


def block_values(blocked: DataFrame, found: DataFrame, keys: list[str], kinds: dict) -> DataFrame:
    """(keys, feature, value): one row per row and known term."""
    def values(rows: pa.Table, found: pa.Table) -> pa.Table:
        got = list(_values(rows, found, kinds)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        row, at, value = (np.concatenate(x) for x in zip(*got))
        return pa.table([*(rows[k].take(pa.array(row)) for k in keys), found["feature"].take(pa.array(at)), pa.array(value)],
                        [*keys, "feature", "value"])
    schema = StructType([*(blocked.schema[k] for k in keys), StructField("feature", StringType()), StructField("value", DoubleType())])
    return _cogrouped(blocked, found).applyInArrow(values, schema)


def label_values(blocked: DataFrame, found: DataFrame, label_col: str, kinds: dict) -> DataFrame:
    """(label, feature, value): values summed over the rows of a label in each
    block; what a classifier fit adds up."""
    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        coded = rows[label_col].combine_chunks().dictionary_encode("encode")
        label, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(found), 1)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for row, at, value in _values(rows, found, kinds):
            key, place = compact(label[row] * n + at, len(coded.dictionary) * n)
            keys.append(key)
            values.append(np.bincount(place, value))
        key, place = compact(np.concatenate(keys), len(coded.dictionary) * n)
        return pa.table([coded.dictionary.take(pa.array(key // n)), found["feature"].take(pa.array(key % n)),
                         pa.array(np.bincount(place, np.concatenate(values), len(key)))], [label_col, "feature", "value"])
    schema = StructType([blocked.schema[label_col], StructField("feature", StringType()), StructField("value", DoubleType())])
    return _cogrouped(blocked, found).applyInArrow(sums, schema)


def model_values(blocked: DataFrame, found: DataFrame, keys: list[str], kinds: dict, width: int) -> DataFrame:
    """(keys, _X, sums array<double> of ``width``) for every row: the sum of its
    values, and of its values times the model rows (idx, val in ``found``, null
    where the model has no such feature)."""
    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        n = len(rows)
        lengths, index, value = flat_model(found)
        total, x = np.zeros((n, width)), np.zeros(n)
        for row, at, w in _values(rows, found, kinds):
            x += np.bincount(row, w, n)
            order = np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")
            row, at, w = row[order], at[order], w[order]
            total += add_up(np.bincount(row, minlength=n), at, w, lengths, index, value, width)
        offsets = pa.array(np.arange(n + 1) * width, pa.int32())
        return pa.table([*(rows[k] for k in keys), pa.array(x), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))],
                        [*keys, "_X", "sums"])
    schema = StructType([*(blocked.schema[k] for k in keys), StructField("_X", DoubleType()), StructField("sums", ArrayType(DoubleType()))])
    return _cogrouped(blocked, found).applyInArrow(sums, schema)
