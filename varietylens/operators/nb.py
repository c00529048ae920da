"""One-vs-rest multinomial naive Bayes (alpha = 1, fitted priors) on a long,
sparse feature table, in closed form.

For class c against the rest, with S[c,f] the summed feature values of class
c, T[f] = sum_c S[c,f], S_c = sum_f S[c,f], T = sum S, F the fitted feature
count and n_c of n training documents in c:

    margin[d,c] = b[c] + k[c] * X_d - Z_d + sum_{f: S[c,f] > 0} x[d,f] * delta[c,f]
    b[c]        = ln(n_c / (n - n_c))
    k[c]        = ln(T - S_c + F) - ln(S_c + F)
    delta[c,f]  = ln(S[c,f] + 1) - ln(T[f] - S[c,f] + 1) + ln(T[f] + 1)
    X_d = sum_f x[d,f],  Z_d = sum_f x[d,f] * ln(T[f] + 1)

which equals b + sum_f x * (ln P(f|c) - ln P(f|not c)) with Laplace smoothing
without ever materialising classes x vocabulary. The posterior of each
binary estimator is sigmoid(margin); class probabilities are those
posteriors divided by their sum (two classes: one estimator, [1-p, p]).

Physical shape: a model row per feature (the deltas of the classes that have
it, and ln(T+1)); documents are dealt into blocks, each distinct feature of a
block is joined with its model row once and the sums are formed inside the
block (``additive.block_sums``). Class-level parameters (K values each) are
held as literal arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..session import materialize, ship
from .additive import CELLS, block_sums
from .tfidf import known, model_values

MAX_CLASSES = 100_000


@dataclass
class NBModel:
    labels: list[str]           # sorted class labels
    log_prior: list[float]      # b[c]
    k: list[float]              # k[c]
    n_docs: list[int]           # n_c
    n_features: int             # F
    feat: DataFrame             # feature, idx, val: deltas by class, ln(T+1) at place K
    stats: DataFrame            # label, feature, S (S > 0 only)

    def labels_col(self) -> Column:
        return F.array(*[F.lit(x) for x in self.labels])


def nb_fit(x: DataFrame, docs: DataFrame, label_col: str, n_features: int,
           materialize_tables: bool = True) -> NBModel:
    """x: (..., label_col, feature, value) for training rows; docs: one row
    per training document with its label (documents without features count
    towards the priors)."""
    classes = (docs.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c")))
    S = (x.groupBy(label_col, "feature").agg(F.sum("value").alias("S"))
          .where(F.col("S") > 0))
    if materialize_tables:
        S = materialize(S)
    S_c = S.groupBy(label_col).agg(F.sum("S").alias("S_c"))
    cls = (classes.join(S_c, on=label_col, how="left")
                  .fillna(0.0, subset=["S_c"]).orderBy(label_col).collect())
    if len(cls) > MAX_CLASSES:
        raise ValueError(f"{len(cls)} classes exceed the class-table bound")
    labels = [r[label_col] for r in cls]
    n = sum(r["n_c"] for r in cls)
    T = sum(float(r["S_c"]) for r in cls)
    log_prior, k = [], []
    for r in cls:
        nc = r["n_c"]
        log_prior.append(math.log(nc / (n - nc)) if n - nc > 0 else float("inf"))
        k.append(math.log(T - r["S_c"] + n_features) - math.log(r["S_c"] + n_features))
    feat = model_rows(S, label_col, labels)
    if materialize_tables:
        feat = materialize(feat)
    return NBModel(labels, log_prior, k, [r["n_c"] for r in cls], n_features, feat, S)


def model_rows(S: DataFrame, label_col: str, labels: list[str]) -> DataFrame:
    """(feature, idx, val): one row per feature, the deltas of the classes that
    have it, ln(T+1) at place K. The sums of a feature are sorted together, then
    rows are formed batch by batch."""
    ship(S.sparkSession)
    K, names = len(labels), pa.array(labels, pa.string())
    width = int(S.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = S.select("feature", F.col(label_col).alias("label"), "S").repartition(width, "feature").sortWithinPartitions("feature")

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            if not len(now):
                continue
            # the last feature may go on in the next batch
            last = now["feature"][-1].as_py()
            ends = pc.index(now["feature"], last).as_py()
            held = now.slice(ends)
            if ends:
                yield made(now.slice(0, ends))
        if held is not None and len(held):
            yield made(held)

    def made(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        feature, s = part["feature"].combine_chunks(), part["S"].to_numpy()
        i = pc.index_in(part["label"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = feature.dictionary_encode()
        first = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
        size = np.diff(np.append(first, len(s)))
        T = np.add.reduceat(s, first)
        t = np.repeat(T, size)
        delta = np.log(s + 1) - np.log(t - s + 1) + np.log(t + 1)
        ends = np.cumsum(size)
        offsets = pa.array(np.append(0, ends + np.arange(1, len(first) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [feature.take(pa.array(first)), pa.ListArray.from_arrays(offsets, pa.array(np.insert(i, ends, K), pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(np.insert(delta, ends, np.log(T + 1))))], names=["feature", "idx", "val"])
    schema = StructType([StructField("feature", StringType()), StructField("idx", ArrayType(IntegerType())),
                         StructField("val", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema)


def nb_sums(x: DataFrame, docs: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """(keys, _X, _Z, _D array<double>) for every row of ``docs``; x holds the
    (normalised) feature values of those documents.

    Per document: X = sum x, Z = sum x ln(T+1), D = sum x * delta per class.
    Z and D come from the documents' blocks (``additive.block_sums``): each
    distinct feature of a block meets the model once. All three are sums over
    features: those of two feature blocks add up."""
    return sums_of(docs, long_model_sums(x, keys, model), keys, len(model.labels))


def sums_of(docs: DataFrame, sums: DataFrame, keys: list[str], K: int) -> DataFrame:
    """(keys, _X, _Z, _D) of ``docs`` from (keys, _X, sums); no features: zeros."""
    d = docs.select(*keys).join(sums, on=keys, how="left")
    got = F.coalesce(F.col("sums"), F.array_repeat(F.lit(0.0), K + 1))
    return d.select(*keys, F.coalesce(F.col("_X"), F.lit(0.0)).alias("_X"), got[K].alias("_Z"), F.slice(got, 1, K).alias("_D"))


def block_model_sums(blocked: DataFrame, asked: DataFrame, vocabs: dict, kinds: dict, keys: list[str],
                     model: NBModel) -> DataFrame:
    """(keys, _X, sums) of the TF-IDF features of text blocks (``tfidf``), which
    are formed inside the blocks and never become a long table."""
    found = known(asked, vocabs).join(model.feat, "feature", "left")
    return model_values(blocked, found, keys, kinds, len(model.labels) + 1)


def long_model_sums(x: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """(keys, _X, sums) of a long feature table."""
    rows = (x.groupBy(*keys).agg(F.collect_list(F.struct("feature", "value")).alias("_f"), F.sum("value").alias("_X"))
             .select(*keys, "_X", F.col("_f.feature").alias("features"), F.col("_f.value").alias("weights")))
    return block_sums(rows, [*keys, "_X"], model.feat, len(model.labels) + 1)


def wide_model_sums(wide: DataFrame, names: list[str], keys: list[str], model: NBModel) -> DataFrame:
    """(keys, _X, sums) of rows (keys, probas) that hold a value for each of the
    features ``names``; rows of equal keys add up, null values as in the long table."""
    weights = F.flatten("_p")
    rows = (wide.groupBy(*keys).agg(F.collect_list("probas").alias("_p"))
                .select(*keys, F.aggregate(weights, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("_X"),
                        F.flatten(F.array_repeat(F.array(*[F.lit(n) for n in names]), F.size("_p"))).alias("features"),
                        weights.alias("weights")))
    return block_sums(rows, [*keys, "_X"], model.feat, len(model.labels) + 1)


def array_model_sums(wide: DataFrame, names: list[str], keys: list[str], model: NBModel) -> DataFrame:
    """As ``wide_model_sums``, where the model rows of ``names`` are few: a row for
    each class at most, as class-level parameters are. Rows stay where they are until
    those of equal keys are added up."""
    K = len(model.labels)
    if len(names) * (K + 1) > CELLS:
        return wide_model_sums(wide, names, keys, model)
    ship(wide.sparkSession)
    table, place = np.zeros((len(names), K + 1)), {n: i for i, n in enumerate(names)}
    for r in model.feat.where(F.col("feature").isin(names)).collect():
        np.add.at(table[place[r["feature"]]], r["idx"], r["val"])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(n, len(names))
            offsets = pa.array(np.arange(n + 1) * (K + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(values.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array((values @ table).ravel()))],
                names=[*keys, "_X", "sums"])
    schema = StructType([*(wide.schema[k] for k in keys), StructField("_X", DoubleType()), StructField("sums", ArrayType(DoubleType()))])
    rows = wide.select(*keys, "probas").mapInArrow(run, schema)
    rows = rows.groupBy(*keys).agg(F.sum("_X").alias("_X"), F.collect_list("sums").alias("_s"))
    return rows.select(*keys, "_X", F.when(F.size("_s") == 1, F.col("_s")[0]).otherwise(F.aggregate(
        "_s", F.array_repeat(F.lit(0.0), K + 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))).alias("sums"))


def array_label_values(wide: DataFrame, names: list[str], label_col: str) -> DataFrame:
    """(label, feature, value) of rows (label, probas), added up batch by batch: what a
    fit adds up further."""
    ship(wide.sparkSession)

    def run(batches):
        for batch in batches:
            coded = batch.column(0).dictionary_encode("encode")
            label, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
            total = np.zeros((n, len(names)))
            np.add.at(total, label, values)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(np.repeat(np.arange(n), len(names)))), pa.array(names * n, pa.string()), pa.array(total.ravel())],
                names=[label_col, "feature", "value"])
    schema = StructType([wide.schema[label_col], StructField("feature", StringType()), StructField("value", DoubleType())])
    return wide.select(label_col, "probas").mapInArrow(run, schema)


def add_sums(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _X, sums) of two groups of features over rows with unique keys."""
    b = b.select(*keys, F.col("_X").alias("_X2"), F.col("sums").alias("sums2"))
    return a.join(b, keys, "left").select(
        *keys, (F.col("_X") + F.coalesce("_X2", F.lit(0.0))).alias("_X"),
        F.when(F.col("sums2").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "sums2", lambda u, v: u + v)).alias("sums"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` formed once: what a lambda names is formed
    again for every element otherwise (a row of K classes would cost K squared)."""
    return F.transform(F.array(value), then)[0]


def _margins(log_prior: list[float], k: list[float], X: Column, Z: Column, D) -> Column:
    """Margins from the sums of a document; D gives that of class i."""
    b = F.array(*[F.lit(float(v)) for v in log_prior])
    k = F.array(*[F.lit(float(v)) for v in k])
    return F.transform(F.sequence(F.lit(0), F.lit(len(log_prior) - 1)), lambda i: b[i] + k[i] * X - Z + D(i))


def nb_margins(x: DataFrame, docs: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """(keys, margins array<double>) for every row of ``docs``."""
    return margins_of(nb_sums(x, docs, keys, model), keys, model)


def margins_of(d: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """(keys, margins) from (keys, _X, _Z, _D)."""
    return d.select(*keys, _let(F.struct("_X", "_Z", "_D"), lambda s: _margins(
        model.log_prior, model.k, s["_X"], s["_Z"], lambda i: s["_D"][i])).alias("margins"))


def class_sums(model: NBModel) -> list[float]:
    """S_c: the summed feature values of each class, in label order."""
    label = model.stats.columns[0]
    got = {r[label]: r["S_c"] for r in model.stats.groupBy(label).agg(F.sum("S").alias("S_c")).collect()}
    return [float(got.get(c, 0.0)) for c in model.labels]


def subset_margins(sums: DataFrame, keys: list[str], models: dict[str, NBModel], subsets: dict[str, list[str]]) -> DataFrame:
    """(keys, subset, margins): margins of the models fitted on each subset of
    feature blocks, from the blocks' sums over the same rows (``X_<block>``,
    ``Z_<block>``, ``D_<block>``). A block's deltas do not depend on the other
    blocks, so the sums add up; only k[c] has to be formed for each subset."""
    S = {name: class_sums(m) for name, m in models.items()}
    first = next(iter(models.values()))
    out = []
    for name, blocks in subsets.items():
        S_c = [sum(S[b][i] for b in blocks) for i in range(len(first.labels))]
        T, n = sum(S_c), sum(models[b].n_features for b in blocks)
        k = [math.log(T - s + n) - math.log(s + n) for s in S_c]
        X, Z = (sum((F.col(f"{v}_{b}") for b in blocks), F.lit(0.0)) for v in "XZ")
        m = _margins(first.log_prior, k, X, Z, lambda i, blocks=blocks: sum((F.col(f"D_{b}")[i] for b in blocks), F.lit(0.0)))
        out.append(F.struct(F.lit(name).alias("subset"), m.alias("margins")))
    return sums.select(*keys, F.explode(F.array(*out)).alias("_s")).select(*keys, "_s.subset", "_s.margins")


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def nb_predict(margins: DataFrame, keys: list[str], model: NBModel,
               pred_col: str = "pred") -> DataFrame:
    """Hard prediction as the library does it: K > 2 -> arg-max of the
    per-class posteriors, the last class wins ties; K == 2 -> the second
    class iff its posterior is > 0.5. NaN posteriors never win; a row with
    no other posterior has no label (NULL)."""
    labels = model.labels_col()
    post = F.transform(F.col("margins"), lambda m: sigmoid(m))
    if len(model.labels) == 2:
        pred = F.when(~F.isnan(post[1]), F.when(post[1] > 0.5, labels[1]).otherwise(labels[0]))
    else:
        def last(s):
            at = F.size(s["rev"]) - F.array_position(s["rev"], s["top"])
            return F.when(s["top"].isNotNull(), F.get(labels, at.cast("int")))
        pred = _let(F.reverse(post), lambda rev: _let(F.struct(rev.alias("rev"), _largest(rev).alias("top")), last))
    return margins.select(*keys, pred.alias(pred_col))


def _largest(values: Column) -> Column:
    """Largest number of an array, NaN and NULL left out; NULL if none is left."""
    return F.array_max(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))


def _posteriors(model: NBModel) -> Column:
    """Posteriors normalised to sum 1; NULL where all of them underflow."""
    post = F.transform(F.col("margins"), lambda m: sigmoid(m))
    if len(model.labels) == 2:
        post = F.array(F.lit(1.0) - post[1], post[1])
    return _let(post, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v), lambda tot: F.transform(
        p, lambda v: F.try_divide(v, tot))))


def nb_proba(margins: DataFrame, keys: list[str], model: NBModel,
             label_out: str = "label") -> DataFrame:
    """Long (keys, label, proba): posteriors normalised to sum 1."""
    labels = model.labels_col()
    return (nb_probas(margins, keys, model).select(*keys, F.posexplode("probas").alias("_i", "proba"))
                   .select(*keys, labels[F.col("_i")].alias(label_out), "proba"))


def nb_probas(margins: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """(keys, probas array<double>): the probabilities in label order."""
    return margins.select(*keys, _posteriors(model).alias("probas"))


def nb_top(margins: DataFrame, keys: list[str], model: NBModel) -> DataFrame:
    """Prediction-API arg-max over the normalised probabilities: the first
    label in sorted order wins ties (strictly-greater scan). Without a
    probability that is a number there is no top label (NULL)."""
    labels = model.labels_col()
    p = _let(_posteriors(model), lambda p: F.struct(p.alias("p"), _largest(p).alias("top")))
    return (margins.select(*keys, p.alias("_p"))
                   .select(*keys,
                           F.when(F.col("_p.top").isNotNull(), F.get(
                               labels, (F.array_position("_p.p", F.col("_p.top")) - 1).cast("int"))).alias("top"),
                           F.col("_p.top").alias("score"),
                           F.map_from_arrays(labels, F.col("_p.p")).alias("scores")))
