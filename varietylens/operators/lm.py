"""Interpolated modified Kneser-Ney n-gram language models, one per
(unit, label), estimated and applied as Spark jobs.

Estimation (per unit, label; sentences wrapped in <s> ... </s>):
 1. raw counts c(g) of every n-gram g, n = 1..N, that does not end at <s>
 2. adjusted counts a(g): c(g) for n = N or g starting with <s>; otherwise
    the number of distinct left extensions v with c(v g) > 0
 3. t[n,k] = #n-grams with a = k (k = 1..4);
    D[n](k) = k - (k+1) * Y * t[n,k+1] / t[n,k], Y = t1 / (t1 + 2 t2), k = 1, 2, 3+;
    an order whose discounts are undefined or outside [0, k] uses the
    fallback (0.5, 1.0, 1.5)
 4. u(w|h) = (a(hw) - D(a(hw))) / sum_x a(hx);
    b(h)   = sum_k D(k) #{x: a(hx) = k} / sum_x a(hx)
 5. p(w|h) = u(w|h) + b(h) p(w|h'),  p(w) = u(w) + b() / |V|,
    |V| = #unigrams + 1 (<unk>; <s> not counted), p(<unk>) = b() / |V|
Scoring: per predicted position, the longest n-gram present gives log10 p,
plus log10 b of each longer context present (ARPA back-off); <unk> for an
unknown word.

Tables: ``probs`` (unit, label, n, gram, logp) and ``backoffs`` (unit,
label, gram, logb), both log10. For scoring they are folded into one sparse
row of additive contributions per gram (see ``contribution_table``), so a
sentence's score is a sum over its grams.

Physical shape: a token is counted with the at most N - 1 before it (a window);
shorter n-grams are ends of windows and are never shuffled. A window lies with its
unit, label and last but one token (``_k``), and so do all its ends of two tokens
and more, their contexts, their suffixes and what extends them to the left. Windows
are shuffled once, added up and written in groups (``_b``); in a group, n-grams are
numbers: an n-gram is its suffix and its first token (``Grams``). What crosses
groups are unigrams and how many n-grams have which adjusted count. Probabilities
are formed where they are asked for, no table of them is kept.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import CHAR_SPACE
from ..session import materialize, materialize_bucketed, ship
from .additive import add_up, block_of, flat_model
from .rowgrams import SLICE, flat, list_ids, sequence_grams, sequence_windows

BOS, EOS, UNK = "<s>", "</s>", "<unk>"
SEP = " "
# Fixed value: discounts used when an order's estimates are unusable.
FALLBACK = (0.5, 1.0, 1.5)
UNITS = ("word", "char")
LONG_SEQUENCE = 1 << 11               # tokens of a row that is a block of its own
MAX_MODELS = 200_000                  # (unit, label) pairs held as literal arrays
GROUPS = 32                           # groups of windows in a partition
HELD = 1 << 18                        # rows of windows added up at a time


def unit_tokens(text: Column, unit: str) -> Column:
    """Tokens an LM sees: whitespace-separated words, or the characters of
    the text with spaces shown as ``X``."""
    if unit == "word":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    # spaces shown as X, any other whitespace dropped (one regex per line)
    stream = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(CHAR_SPACE)), r"\s", "")
    return F.filter(F.split(stream, ""), lambda c: c != "")


def bounded(toks: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), toks, F.array(F.lit(EOS)))


def ngram_counts(sents: DataFrame, order: int) -> DataFrame:
    """sents: (unit, label, toks) -> (unit, label, n, gram, c)."""
    return _summed(_batch_counts(sents, order), ["unit", "label", "n", "gram"], [])


def _summed(rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Counts added up; ``place``: the columns of ``by`` that say where (all of them if none).
    Batches are counted already: their rows go straight to the task that adds them
    up, a map-side table of (mostly distinct) strings would only spill."""
    return rows.repartition(_width(rows), *(place or by)).groupBy(*by).agg(F.sum("c").alias("c"))


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _batch_counts(sents: DataFrame, order: int, place: bool = False) -> DataFrame:
    """(unit, label, n, gram, c) of batches of sentences, counted in Arrow
    (``rowgrams``): what is shuffled is a batch's distinct (label, n-gram), and a
    frequent n-gram is no hot task. Sentences of a label lie together, so that a batch
    has few labels. ``place``: with ``_k``, a hash of the unit, the label and the last
    but one token (a unigram's own), which says where a gram lies and decides on the
    place alone, never on equality."""
    ship(sents.sparkSession)
    rows = sents.select("unit", "label", "toks").where(F.col("toks").isNotNull()).sortWithinPartitions("unit", "label")

    def run(batches):
        for batch in batches:
            (unit, units), (label, labels) = (_coded(batch.column(i)) for i in (0, 1))
            group = unit * max(len(labels), 1) + label
            model = np.array([zlib.crc32(repr((u, v)).encode()) for u in units.to_pylist() for v in labels.to_pylist()], np.uint64)
            for n, row, starts, gram, names, ahead in sequence_grams(batch.column(2), order, BOS, EOS, SEP):
                # no n-gram ends at <s>
                key, c = np.unique(group[row[~starts]] * len(names) + gram[~starts], return_counts=True)
                which, gram = key // len(names), key % len(names)
                columns = [units.take(pa.array(which // len(labels))), labels.take(pa.array(which % len(labels))),
                           pa.array(np.full(len(key), n, np.int32)), names.take(pa.array(gram)).cast(pa.string()), pa.array(c)]
                if place:
                    token = np.array([zlib.crc32(t.encode()) for t in ahead[1].to_pylist()], np.uint64)[ahead[0]]
                    columns.append(pa.array((model[which] << np.uint64(32) | token[gram]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "label", "n", "gram", "c", "_k"][:len(columns)])
    schema = StructType([rows.schema["unit"], rows.schema["label"], StructField("n", IntegerType()),
                         StructField("gram", StringType()), StructField("c", LongType())] + [StructField("_k", LongType())] * place)
    return rows.mapInArrow(run, schema)


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _part(gram: str, count: str) -> Column:
    """The first ``count`` tokens of a gram (the last ones if negative)."""
    return F.expr(f"substring_index({gram}, '{SEP}', {count})")


def suffix_of() -> Column:
    """All but the first token (empty for a unigram)."""
    return _part("gram", "1 - n")


def prefix_of() -> Column:
    """All but the last token (the context; empty for a unigram)."""
    return _part("gram", "n - 1")


def adjusted_counts(counts: DataFrame, order: int) -> DataFrame:
    """(unit, label, n, gram, c, a)."""
    return _adjusted(counts, order, ["unit", "label", "n", "gram"], 1)


def _adjusted(counts: DataFrame, order: int, by: list[str], least: int) -> DataFrame:
    """(by, c, a): every gram counts once for its suffix (of ``least`` tokens or
    more). A gram starting with <s> keeps its count, so do those of the order."""
    own = F.struct(*by, "c", F.lit(0).cast("long").alias("x"))
    left = F.struct(*[F.col(v) for v in by if v not in ("n", "gram")], (F.col("n") - 1).alias("n"), suffix_of().alias("gram"),
                    F.lit(None).cast("long").alias("c"), F.lit(1).cast("long").alias("x"))
    rows = counts.select(*[F.col(v) for v in by if v not in ("n", "gram")], F.explode(
        F.when(F.col("n") > least, F.array(own, left)).otherwise(F.array(own))).alias("_g"))
    g = (rows.select(*[v for v in by if v not in ("n", "gram")], F.col("_g.n").alias("n"), F.col("_g.gram").alias("gram"),
                     F.col("_g.c").alias("c"), F.col("_g.x").alias("x"))
             .groupBy(*by).agg(F.sum("c").alias("c"), F.sum("x").alias("x")).where(F.col("c").isNotNull()))
    return g.withColumn("a", F.when(_raw(order), F.col("c")).otherwise(F.col("x"))).drop("x")


def _raw(order: int) -> Column:
    return (F.col("n") == order) | F.col("gram").startswith(BOS + SEP) | (F.col("gram") == BOS)


def discounts(adj: DataFrame) -> DataFrame:
    """(unit, label, n, d1, d2, d3) with the fallback rule."""
    return _discounts(_times(adj))


def _times(adj: DataFrame) -> DataFrame:
    """(unit, label, n, t1..t4): how many n-grams have which adjusted count."""
    return adj.groupBy("unit", "label", "n").agg(
        *[F.count_if(F.col("a") == k).alias(f"t{k}") for k in (1, 2, 3, 4)])


def _discounts(t: DataFrame) -> DataFrame:
    y = F.try_divide(F.col("t1").cast("double"), (F.col("t1") + 2 * F.col("t2")).cast("double"))
    ds = {}
    for k in (1, 2, 3):
        ds[k] = F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(f"t{k + 1}"), F.col(f"t{k}").cast("double"))
    t = t.select("unit", "label", "n", *[ds[k].alias(f"r{k}") for k in (1, 2, 3)])
    ok = None
    for k in (1, 2, 3):
        r = F.col(f"r{k}")
        cond = r.isNotNull() & ~F.isnan(r) & (r >= 0) & (r <= k)
        ok = cond if ok is None else ok & cond
    return t.select("unit", "label", "n",
                    *[F.when(ok, F.col(f"r{k}")).otherwise(F.lit(FALLBACK[k - 1])).alias(f"d{k}")
                      for k in (1, 2, 3)])


class Grams:
    """The n-grams (n = 1..order) that windows end with, as numbers: gram i of n
    tokens is the gram ``parent[n][i]`` of n - 1 tokens with ``token[n][i]`` before it;
    ``model`` and ``count`` are its own. ``at[n]``: each window's gram (-1: shorter)."""

    def __init__(self, model: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocab: pa.Array, count: np.ndarray, order: int):
        self.vocab, self.order = vocab, order
        ends, size = np.cumsum(lengths), max(len(vocab), 1)
        self.parent, self.token, self.model, self.count, self.at = {}, {}, {}, {}, {0: model}
        for n in range(1, order + 1):
            rows = np.flatnonzero(lengths >= n)
            found, made = np.unique(self.at[n - 1][rows] * size + ids[ends[rows] - n], return_inverse=True)
            self.parent[n], self.token[n] = np.divmod(found, size)
            if n == 1:
                self.first = found
            self.model[n] = self.model[n - 1][self.parent[n]] if n > 1 else self.parent[n]
            self.count[n] = np.bincount(made, count[rows], len(found)).astype(np.int64)
            self.at[n] = np.full(len(model), -1)
            self.at[n][rows] = made

    def adjusted(self, n: int) -> np.ndarray:
        """a(g) of the grams of n tokens (of two or more, or of the order)."""
        if n == self.order:
            return self.count[n]
        left = np.bincount(self.parent[n + 1], minlength=len(self.token[n]))
        return np.where(pc.equal(self.vocab, BOS).to_numpy(zero_copy_only=False)[self.token[n]], self.count[n], left)

    def before(self, token: np.ndarray, names: pa.Array, parent: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(self.vocab.take(pa.array(token)), names.take(pa.array(parent)), pa.scalar(SEP, pa.large_string()))


def _grams_of(rows: pa.Table, order: int, known: pa.Table | None = None):
    """(Grams of the windows ``rows``, units, labels, windows' lengths, keys of the
    unigrams ``known`` as in ``Grams.first``). A model is unit * number of labels + label."""
    parts = [rows] if known is None else [rows, known]
    (unit, units), (label, labels) = (_coded(pa.concat_arrays([t[c].combine_chunks() for t in parts])) for c in ("unit", "label"))
    texts = [t["gram"].combine_chunks().cast(pa.large_string()) for t in parts]
    lengths, tokens = flat(pc.split_pattern(texts[0], SEP))
    ids, vocab = list_ids(pa.concat_arrays([tokens, *texts[1:]]))
    model = unit * max(len(labels), 1) + label
    g = Grams(model[:len(rows)], lengths, ids[:len(tokens)], vocab, rows["c"].to_numpy(), order)
    return g, units, labels, lengths, model[len(rows):] * max(len(vocab), 1) + ids[len(tokens):]


def _batch_windows(sents: DataFrame, order: int) -> DataFrame:
    """(_k, unit, label, gram, c): the windows of batches of sentences, counted in
    Arrow. ``_k`` decides on the place alone, never on equality."""
    ship(sents.sparkSession)
    rows = (sents.select("unit", "label", "toks").where("toks IS NOT NULL AND unit IS NOT NULL AND label IS NOT NULL")
                 .sortWithinPartitions("unit", "label"))

    def counted(batches):
        batch = pa.Table.from_batches(batches).combine_chunks()
        (unit, units), (label, labels) = (_coded(batch.column(i).combine_chunks()) for i in (0, 1))
        size = max(len(labels), 1)
        model = np.array([zlib.crc32(repr((u, v)).encode()) for u in units.to_pylist() for v in labels.to_pylist()], np.uint64)
        for which, names, times, ahead, vocab in sequence_windows(batch.column(2), unit * size + label, order, BOS, EOS, SEP):
            token = np.array([zlib.crc32(t.encode()) for t in vocab.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((model[which] << np.uint64(32) | token[ahead]).view(np.int64)), units.take(pa.array(which // size)),
                 labels.take(pa.array(which % size)), names.cast(pa.string()), pa.array(times)], names=["_k", "unit", "label", "gram", "c"])

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += len(batch.column(2).values) + 2 * batch.num_rows
            if many >= SLICE:
                yield from counted(held)
                held, many = [], 0
        if held:
            yield from counted(held)
    schema = StructType([StructField("_k", LongType()), rows.schema["unit"], rows.schema["label"],
                         StructField("gram", StringType()), StructField("c", LongType())])
    return rows.mapInArrow(run, schema)


def _whole_places(batches):
    """Tables of rows sorted by ``_k`` that hold whole places, of ``HELD`` rows or
    more. A place of many rows is added up on the way, so what is held follows its
    distinct windows."""
    held, many, most = [], 0, HELD

    def added(parts):
        t = pa.Table.from_batches(parts)
        by = [c for c in t.column_names if c != "c"]
        return (t.group_by(by, use_threads=False).aggregate([("c", "sum")]).rename_columns([*by, "c"])
                 .select(t.column_names).combine_chunks().to_batches())

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        many += batch.num_rows
        if many < most:
            continue
        # where the last place begins, which may go on
        last, at, cut = batch["_k"][-1].as_py(), len(held), 0
        while at and not cut:
            at -= 1
            others = np.flatnonzero(held[at]["_k"].to_numpy() != last)
            cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield pa.Table.from_batches([*held[:at], held[at].slice(0, cut)])
            held = [b for b in (held[at].slice(cut), *held[at + 1:]) if b.num_rows]
        many, most = sum(b.num_rows for b in held), HELD
        if many >= most:
            held = added(held)
            many = sum(b.num_rows for b in held)
            most = max(HELD, 2 * many)
    if held:
        yield pa.Table.from_batches(held)


def _windows(sents: DataFrame, order: int, keep: bool = True) -> DataFrame:
    """(_b, kind, unit, label, n, gram, c, x), partitioned by ``_b``. Kind 0 (if
    ``keep``): windows and their counts; 1: ``c`` n-grams (n >= 2) have the adjusted
    count ``x`` (5: 5 or more); 2: a token that ends windows of ``_b``, its count and how
    many bigrams end with it."""
    width = _width(sents)
    groups = width * GROUPS
    rows = _batch_windows(sents, order).withColumn("_b", F.pmod(F.xxhash64("_k"), F.lit(groups)).cast("int"))
    rows = rows.repartition(width, "_b").sortWithinPartitions("_b", "_k")

    def run(batches):
        for t in _whole_places(batches):
            gram, group, count = t["gram"].combine_chunks(), t["_b"].to_numpy(), t["c"].to_numpy()
            g, units, labels, lengths, _ = _grams_of(t, order)
            size = max(len(labels), 1)

            def rows_of(b, kind, model, n, names, c, x):
                return pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), pa.array(np.full(len(b), kind, np.int32)), units.take(pa.array(model // size)),
                     labels.take(pa.array(model % size)), pa.array(np.full(len(b), n, np.int32)), names, pa.array(c, pa.int64()), pa.array(x, pa.int64())],
                    names=["_b", "kind", "unit", "label", "n", "gram", "c", "x"])
            if keep:
                for n in range(1, order + 1):
                    mine = np.flatnonzero(lengths == n)
                    node, first, made = np.unique(g.at[n][mine], return_index=True, return_inverse=True)
                    yield rows_of(group[mine[first]], 0, g.model[n][node], n, gram.take(pa.array(mine[first])).cast(pa.string()),
                                  np.bincount(made, count[mine], len(node)).astype(np.int64), np.zeros(len(node), np.int64))
            for n in range(2, order + 1):
                key, times = np.unique(g.model[n] * 5 + np.minimum(g.adjusted(n), 5) - 1, return_counts=True)
                yield rows_of(np.full(len(key), group[0]), 1, key // 5, n, pa.nulls(len(key), pa.string()), times, key % 5 + 1)
            # a token's windows may lie in several groups: its bigrams of each
            top = min(2, order)
            of = np.zeros(len(g.token[top]), np.int64)
            seen = g.at[top] >= 0
            of[g.at[top][seen]] = group[seen]
            word = g.parent[2] if order > 1 else np.arange(len(of))
            key, made = np.unique(of * max(len(g.token[1]), 1) + word, return_inverse=True)
            b, word = np.divmod(key, max(len(g.token[1]), 1))
            yield rows_of(b, 2, g.model[1][word], 1, g.vocab.take(pa.array(g.token[1][word])).cast(pa.string()),
                          np.bincount(made, g.count[top], len(key)).astype(np.int64), np.bincount(made, minlength=len(key)) * (order > 1))
    schema = StructType([StructField("_b", IntegerType()), StructField("kind", IntegerType()), rows.schema["unit"], rows.schema["label"],
                         StructField("n", IntegerType()), StructField("gram", StringType()), StructField("c", LongType()), StructField("x", LongType())])
    return rows.mapInArrow(run, schema)


def _unigrams(rows: DataFrame, order: int) -> DataFrame:
    """(unit, label, gram, n, a, _bs): unigrams and the groups whose windows end with them."""
    uni = (rows.where("kind = 2").groupBy("unit", "label", "gram")
               .agg(F.sum("c").alias("c"), F.sum("x").alias("x"), F.collect_set("_b").alias("_bs")))
    return uni.withColumn("n", F.lit(1)).withColumn("a", F.when(_raw(order), F.col("c")).otherwise(F.col("x"))).drop("c", "x")


def _all_discounts(rows: DataFrame, uni: DataFrame) -> DataFrame:
    """(unit, label, n, d1, d2, d3) of every order."""
    longer = rows.where("kind = 1").groupBy("unit", "label", "n").agg(
        *[F.sum(F.when(F.col("x") == k, F.col("c")).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3, 4)])
    return _discounts(_times(uni).unionByName(longer))


def sentence_discounts(sents: DataFrame, order: int) -> DataFrame:
    """sents: (unit, label, toks) -> (unit, label, n, d1, d2, d3)."""
    # windows themselves are not kept: what is left is read twice
    rows = materialize(_windows(sents, order, keep=False))
    return _all_discounts(rows, _unigrams(rows, order))


_LEVELS = StructType([StructField("kind", IntegerType()), StructField("unit", StringType()), StructField("label", StringType()),
                      StructField("n", IntegerType()), StructField("gram", StringType())]
                     + [StructField(c, DoubleType()) for c in ("logp", "logp_suffix", "logb")])


def _log10(x: np.ndarray) -> pa.Array:
    """Null where there is none."""
    return pa.array(np.log10(np.where(x > 0, x, 1)), mask=~(x > 0))


def _level_rows(order: int, disc: dict):
    """Rows of a group's n-grams (n >= 2), kind 0, and of their contexts, kind 1."""
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], t) for t in _ARROW], _LEVELS.names)
        known = known.rename_columns([c.removeprefix("_") for c in known.column_names])
        g, units, labels, _, asked = _grams_of(rows, order, known)
        width, many = max(len(g.vocab), 1), len(labels)
        by = np.argsort(asked)
        p = known["p"].to_numpy()[by[np.searchsorted(asked[by], g.first)]]
        names, parts, context, of = g.vocab.take(pa.array(g.token[1])), [], g.model[1], None

        def table(kind, model, n, gram, *logs):
            logs += (pa.nulls(len(model), pa.float64()),) * (3 - len(logs))
            cols = [pa.array(np.full(len(model), kind, np.int32)), units.take(pa.array(model // many)), labels.take(pa.array(model % many)),
                    pa.array(np.full(len(model), n, np.int32)), gram.cast(pa.string()), *logs]
            parts.append(pa.table(cols, _LEVELS.names))

        none = (math.nan,) * 3
        for n in range(2, order + 1):
            a, model, parent, token = g.adjusted(n), g.model[n], g.parent[n], g.token[n]
            d = np.array([disc.get((u, v, n), none) for u in units.to_pylist() for v in labels.to_pylist()])[model, np.minimum(a, 3) - 1]
            # a context is its own suffix and the token before it; of a bigram it is one token
            found, own = np.unique((model if n == 2 else context[parent]) * width + token, return_inverse=True)
            up, first = np.divmod(found, width)
            said = g.vocab.take(pa.array(first)) if n == 2 else g.before(first, said, up)
            of, context = up if n == 2 else of[up], own
            den = np.bincount(own, a, len(found))
            b = np.bincount(own, d, len(found)) / den
            lower = p[parent]
            p = (a - d) / den[own] + b[own] * lower
            names = g.before(token, names, parent)
            table(0, model, n, names, _log10(p), _log10(lower), _log10(b[own]))
            table(1, of, n - 1, said, pa.nulls(len(of), pa.float64()), pa.nulls(len(of), pa.float64()), _log10(b))
        return pa.concat_tables(parts) if parts else run(rows.slice(0, 0), known)
    return run


_ARROW = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]


@dataclass
class Fitted:
    """Windows in their groups and what is known of all groups together."""
    order: int
    rows: DataFrame          # _b, kind, unit, label, n, gram, c, x (as ``_windows``)
    uni: DataFrame           # unit, label, gram, n, a, _bs, p
    base: DataFrame          # unit, label, V, den, b0
    disc: DataFrame          # unit, label, n, d1, d2, d3

    def levels(self, unit: str | None = None) -> DataFrame:
        """(kind, unit, label, n, gram, logp, logp_suffix, logb): n-grams of two tokens
        and more with their context's logb (kind 0), contexts (kind 1); of one unit or all."""
        mine = F.lit(True) if unit is None else F.col("unit") == unit
        disc = {(r["unit"], r["label"], r["n"]): (r["d1"], r["d2"], r["d3"]) for r in self.disc.where(mine & (F.col("n") > 1)).collect()}
        asked = self.uni.where(mine).select(F.explode("_bs").alias("_by"), F.col("unit").alias("_unit"), F.col("label").alias("_label"), F.col("gram").alias("_gram"), "p")
        windows = self.rows.where(mine & (F.col("kind") == 0)).select("_b", "unit", "label", "gram", "c")
        ship(windows.sparkSession)
        return windows.groupBy("_b").cogroup(asked.groupBy("_by")).applyInArrow(_level_rows(self.order, disc), _LEVELS)

    def unigrams(self, unit: str | None = None) -> DataFrame:
        mine = F.lit(True) if unit is None else F.col("unit") == unit
        return self.uni.where(mine).select("unit", "label", "n", "gram", F.log10("p").alias("logp"))

    def unk(self) -> DataFrame:
        return self.base.select("unit", "label", F.log10(F.col("b0") / F.col("V")).alias("logp_unk"))


def fitted_windows(sents: DataFrame, order: int, materialize_tables: bool = True) -> Fitted:
    """sents: (unit, label, toks)."""
    rows = _windows(sents, order)
    if materialize_tables:
        rows = materialize_bucketed(rows, "_b", _width(sents), placed=True)
    uni = _unigrams(rows, order)
    uni = materialize(uni) if materialize_tables else uni
    # class-level tables are written in any case: a few rows, read at every order
    disc = materialize(_all_discounts(rows, uni).coalesce(1))
    # unigram level: uniform base over |V| = #unigrams + 1
    d = (F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2"))
          .when(F.col("a") >= 3, F.col("d3")).otherwise(F.lit(0.0)))
    own = uni.join(F.broadcast(disc), ["unit", "label", "n"]).withColumn("D", d)
    base = materialize(own.groupBy("unit", "label").agg((F.count(F.lit(1)) + 1).alias("V"), F.sum("a").alias("den"), F.sum("D").alias("dmass"))
                          .select("unit", "label", "V", "den", (F.col("dmass") / F.col("den")).alias("b0")).coalesce(1))
    uni = own.join(F.broadcast(base), ["unit", "label"]).select(
        "unit", "label", "gram", "n", "a", "_bs", ((F.col("a") - F.col("D")) / F.col("den") + F.col("b0") / F.col("V")).alias("p"))
    return Fitted(order, rows, uni, base, disc)


def estimate(sents: DataFrame, order: int, materialize_tables: bool = True) -> tuple:
    """sents: (unit, label, toks). Returns (probs, backoffs, unk, discounts)."""
    f = fitted_windows(sents, order, materialize_tables)
    return *_tables(f), f.unk(), f.disc


def _tables(f: Fitted) -> tuple[DataFrame, DataFrame]:
    """(probs, backoffs), formed when they are asked for."""
    none = F.lit(None).cast("double")
    levels = f.levels()
    probs = f.unigrams().select("unit", "label", "n", "gram", "logp", none.alias("logp_suffix"), none.alias("logb_context")).unionByName(
        levels.where("kind = 0").select("unit", "label", "n", "gram", "logp", "logp_suffix", F.col("logb").alias("logb_context")))
    return probs, levels.where("kind = 1").select("unit", "label", "gram", "logb")


@dataclass
class LMModel:
    order: int
    labels: list[str]        # sorted labels (same for every unit)
    fitted: Fitted
    probs: DataFrame         # unit, label, n, gram, logp, its suffix's logp, its context's logb
    backoffs: DataFrame      # unit, label, gram, logb
    unk: DataFrame           # unit, label, logp_unk
    unk_wide: dict           # unit -> list[float] log10 p(<unk>) per label
    materialize_tables: bool = True
    _contrib: dict = field(default_factory=dict)

    def contributions(self, unit: str | None = None) -> DataFrame:
        """Additive contribution table (unit, feature, idx, val) of one unit (of
        all), built on first use."""
        if unit not in self._contrib:
            table = contribution_table(self.fitted.unigrams(unit), self.fitted.levels(unit), self.unk, self.labels)
            self._contrib[unit] = materialize(table) if self.materialize_tables else table
        return self._contrib[unit]


def fit_lm(sents: DataFrame, order: int, materialize_tables: bool = True) -> LMModel:
    """sents: (unit, label, toks)."""
    fitted = fitted_windows(sents, order, materialize_tables)
    unk = fitted.unk()
    if unk.count() > MAX_MODELS:
        raise ValueError("too many (unit, label) models for one LM table")
    unk_rows = unk.collect()          # units x labels rows (bounded above)
    labels = sorted({r["label"] for r in unk_rows})
    pos = {lab: i for i, lab in enumerate(labels)}
    unk_wide = {}
    for r in unk_rows:
        unk_wide.setdefault(r["unit"], [float("-inf")] * len(labels))[pos[r["label"]]] = r["logp_unk"]
    return LMModel(order, labels, fitted, *_tables(fitted), unk, unk_wide, materialize_tables)


def contribution_table(uni: DataFrame, levels: DataFrame, unk: DataFrame, labels: list[str]) -> DataFrame:
    """(unit, feature, idx, val): the n-gram's contribution C_j for each label
    j that has it (positions in ``labels``), such that the log10 score of a
    sentence under label j is  n_positions * log10 p_j(<unk>) + sum over
    every n-gram occurrence g of C_j(g)  (with the context "<s>").

    Derivation: at a position with matched grams g_1..g_m (suffix-closed),
    log p(g_m) = log p(<unk>) + sum_l [log p(g_l) - log p(g_(l-1))] and the
    back-offs of contexts m..L equal all contexts 1..L minus the prefixes of
    g_2..g_m. Hence C(g) = [g in P] (log p(g) - log p(suffix g) - log b(prefix g))
    + [g is a context] log b(g), with log p(suffix of a unigram) = log p(<unk>)
    and log b(prefix of a unigram) = 0; absent terms are 0."""
    places = F.broadcast(uni.sparkSession.createDataFrame(pa.table([pa.array(range(len(labels)), pa.int32()), pa.array(labels, pa.string())], ["i", "label"])))
    c = uni.join(F.broadcast(unk), ["unit", "label"]).select("unit", "label", "gram", (F.col("logp") - F.col("logp_unk")).alias("c"))
    own = F.col("logp") - F.col("logp_suffix") - F.coalesce("logb", F.lit(0.0))
    c = c.unionByName(levels.select("unit", "label", "gram", F.when(F.col("kind") == 0, own).otherwise(F.col("logb")).alias("c"))).join(places, "label")
    # both sums where the gram lies: groups of grams, put together in Arrow
    place = F.pmod(F.xxhash64("unit", "gram"), F.lit(_width(c) * GROUPS)).cast("int")
    schema = StructType([c.schema["unit"], StructField("feature", StringType()), StructField("idx", ArrayType(IntegerType())),
                         StructField("val", ArrayType(DoubleType()))])
    return c.select(place.alias("_g"), "unit", F.col("gram").alias("feature"), "i", "c").groupBy("_g").applyInArrow(_sparse_rows, schema)


def _sparse_rows(rows: pa.Table) -> pa.Table:
    """A row per (unit, feature) with its sums by ``i``; a null adds nothing, and is the
    sum of nulls alone."""
    (unit, units), (feature, features) = (_coded(rows[c].combine_chunks()) for c in ("unit", "feature"))
    i, many = rows["i"].to_numpy(), max(len(features), 1)
    wide = int(i.max(initial=0)) + 1
    key, made = np.unique((unit * many + feature) * wide + i, return_inverse=True)
    c = rows["c"].to_numpy()
    there = ~np.isnan(c)
    val = np.bincount(made[there], c[there], len(key))
    name, i = np.divmod(key, wide)
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    offsets = pa.array(np.append(first, len(key)), pa.int32())
    name = name[first]
    return pa.table([units.take(pa.array(name // many)), features.take(pa.array(name % many)),
                     pa.ListArray.from_arrays(offsets, pa.array(i, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(val, mask=np.bincount(made[there], minlength=len(key)) == 0))],
                    ["unit", "feature", "idx", "val"])


def score(model: LMModel, df: DataFrame, keys: list[str], unit: str, toks: Column) -> DataFrame:
    """(keys, scores array<double>): log10 probability of each row's token
    sequence (with <s>, </s>) under every label's LM, in sorted label order.

    Plan: rows are dealt into blocks, the distinct n-grams of a block (orders
    1..N, and the context "<s>") are joined once with the contribution rows, and
    occurrences are added up inside the block, which forms its n-grams again
    rather than have them written. What is shuffled class-wide follows the
    distinct n-grams of the blocks, not the occurrences."""
    return _scored(model, df, keys, unit, toks, False, "scores")


def features(model: LMModel, df: DataFrame, keys: list[str], unit: str, toks: Column) -> DataFrame:
    """(keys, probas array<double>): exp of the (log10) scores, L2-normalised; a row
    of zeros (underflow) stays zero."""
    return _scored(model, df, keys, unit, toks, True, "probas")


def _scored(model: LMModel, df: DataFrame, keys: list[str], unit: str, toks: Column, normal: bool, out: str) -> DataFrame:
    order, width = model.order, len(model.labels)
    rows = df.select(*keys, toks.alias("_toks")).withColumn("_npos", F.size("_toks") + 1)
    blocked = materialize(sequence_blocks(rows, width))
    asked = blocked.select("_block", "_toks").groupBy("_block").applyInArrow(
        _asked_function(order), "_by long, feature string")
    table = model.contributions(unit).select("feature", "idx", "val")
    schema = StructType([*(blocked.schema[k] for k in keys), StructField(out, ArrayType(DoubleType()))])
    unk = np.array(model.unk_wide[unit], float)
    return (blocked.groupBy("_block").cogroup(asked.join(table, "feature").groupBy("_by"))
                   .applyInArrow(_score_function(keys, order, unk, normal, out), schema))


def sequence_blocks(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``_block``. n-grams are formed a slice at a time, so what
    bounds a block is its tokens; rows apart ask for class-wide rows each."""
    return block_of(rows, width, F.size("_toks") > LONG_SEQUENCE)


def _asked_function(order: int):
    def grams(rows: pa.Table) -> pa.Table:
        names = [pa.array([], pa.large_string())]
        names += [part[4] for part in sequence_grams(rows["_toks"].combine_chunks(), order, BOS, EOS, SEP)]
        made = pc.unique(pa.concat_arrays(names)).cast(pa.string())
        return pa.table([pa.array(np.full(len(made), rows["_block"][0].as_py())), made], ["_by", "feature"])
    return grams


def _score_function(keys: list[str], order: int, unk: np.ndarray, normal: bool, out: str):
    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        n, width = len(rows), len(unk)
        total, model = np.zeros((n, width)), flat_model(found)
        known = found["feature"].combine_chunks().cast(pa.large_string())
        for _, row, _, gram, names, _ in sequence_grams(rows["_toks"].combine_chunks(), order, BOS, EOS, SEP):
            at = pc.index_in(names, known).fill_null(-1).to_numpy().astype(np.int64)
            key, times = np.unique(row * len(names) + gram, return_counts=True)
            row, at = key // len(names), at[key % len(names)]
            total += add_up(np.bincount(row, minlength=n), at, times.astype(float), *model, width)
        total += rows["_npos"].to_numpy()[:, None] * unk
        if normal:
            total = normal_exp(total)
        offsets = pa.array(np.arange(n + 1) * width, pa.int32())
        return pa.table([*(rows[k] for k in keys), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], [*keys, out])
    return sums


def normal_exp(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores)
    norm = np.sqrt((e * e).sum(axis=1, keepdims=True))
    return np.divide(e, norm, out=e.copy(), where=~(norm <= 0))


def fit_lms(train: DataFrame, text_col: str, label_col: str, order: int,
            materialize_tables: bool = True, profile: str | None = None, units: tuple = UNITS):
    """Word and char LMs (those of ``units``) for every label of ``train``;
    returns ({unit: LMModel}, labels)."""
    sents = None
    for unit in units:
        part = train.select(F.lit(unit).alias("unit"), F.col(label_col).alias("label"),
                            unit_tokens(F.col(text_col), unit).alias("toks"))
        sents = part if sents is None else sents.unionByName(part)
    model = fit_lm(sents, order, materialize_tables)
    return {"lm": model}, model.labels


def lm_feature_arrays(lms: dict, labels: list[str], df: DataFrame, keys: list[str], text_col: str) -> list[tuple[DataFrame, list[str]]]:
    """LM features, per unit (keys, probas) and the names of its features,
    ``lw:<label>`` / ``lc:<label>``."""
    return [(features(lms["lm"], df, keys, unit, unit_tokens(F.col(text_col), unit)), [f"{tag}:{x}" for x in labels])
            for unit, tag in (("word", "lw"), ("char", "lc"))]
