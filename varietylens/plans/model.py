"""Fit / apply / evaluate the stacked text-variety classifier.

Feature blocks (each a long table ``(keys, feature, value)``, unioned):
  w:  word n-gram TF-IDF, L2 per row
  c:  character n-gram TF-IDF, L2 per row
  lw: / lc:  word / char LM scores, exp + L2 over labels (optional)
  x:  class probabilities of an "extra" classifier (optional)
  L<i>:  class probabilities of aggregated layers (optional)
then one-vs-rest multinomial naive Bayes (``operators.nb``).

Fitted tables (vocabularies, NB sufficient statistics) are materialised with
reliable checkpoints; class-level parameters are small literal arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nb as nbo
from ..operators.evaluate import levels_eval
from ..operators.joins import known_rows, with_rows
from ..operators.ngrams import char_term_counts, word_term_counts
from ..operators.tfidf import block_terms, block_values, known, label_values, text_blocks, vocabulary
from ..session import materialize
from .corpus import profile_text

TEXT = "_text"


@dataclass(frozen=True)
class ModelSpec:
    level: str = "city"
    word: tuple | None = (1, 1)
    char: tuple | None = (1, 3)
    lm_order: int = 0                 # 0: no LM feature block
    lm_exclude: tuple = ()            # labels without an LM of their own
    profile: str = "agg"              # text profile for fit and apply
    text_col: str = "original_sentence"
    label_col: str = "label"
    materialize: bool = True


@dataclass
class FittedModel:
    spec: ModelSpec
    keys: list[str]
    vocabs: dict = field(default_factory=dict)   # block -> (term, df, idf)
    lms: dict = field(default_factory=dict)      # unit -> LM model
    lm_labels: list = field(default_factory=list)
    stacked: list = field(default_factory=list)  # [(block name, FittedModel)]
    nb: nbo.NBModel | None = None

    @property
    def labels(self) -> list[str]:
        return self.nb.labels


def _prep(df: DataFrame, spec: ModelSpec) -> DataFrame:
    return df.withColumn(TEXT, profile_text(F.col(spec.text_col), spec.profile))


def block_tf(block: str, spec: ModelSpec, prepped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf) of one TF-IDF block."""
    count = word_term_counts if block == "w" else char_term_counts
    return count(prepped, keys, TEXT, *kinds_of(spec)[block])


def kinds_of(spec: ModelSpec) -> dict:
    """TF-IDF block -> shortest and longest n-gram."""
    return {b: on for b, on in (("w", spec.word), ("c", spec.char)) if on}


def tfidf_features(fitted: FittedModel, prepped: DataFrame, keys: list[str], only: str | None = None) -> DataFrame:
    """(keys, feature, value) of the TF-IDF blocks, or of one of them."""
    kinds = {b: on for b, on in kinds_of(fitted.spec).items() if only in (None, b)}
    blocked = text_blocks(prepped, keys, TEXT)
    found = known(block_terms(blocked, kinds), {b: fitted.vocabs[b] for b in kinds})
    return block_values(blocked, found, keys, kinds)


def lm_arrays(fitted: FittedModel, prepped: DataFrame, keys: list[str]) -> list[tuple[DataFrame, list[str]]]:
    """LM features of the rows as arrays, (keys, probas) and names per unit."""
    if not fitted.lms:
        return []
    from ..operators.lm import lm_feature_arrays
    return lm_feature_arrays(fitted.lms, fitted.lm_labels, prepped, keys, TEXT)


def stacked_blocks(fitted: FittedModel, df: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Stacked probability blocks."""
    return [sub.of(df, keys) if isinstance(sub, PrecomputedBlock) else proba_block(sub, df, keys, name)
            for name, sub in fitted.stacked]


@dataclass
class PrecomputedBlock:
    """A stacked model's probability block computed once for every row it
    will be asked about (materialised), reused by several main-model fits."""
    table: DataFrame          # keys, feature, value
    keys: list
    n_labels: int
    wide: DataFrame | None = None     # keys, probas: what ``table`` is read from, if it is
    names: list = field(default_factory=list)    # the features of ``probas``

    @property
    def labels(self) -> list:
        return [None] * self.n_labels

    def of(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, feature, value) for ``rows``; arrays are joined, then opened."""
        if self.wide is None:
            return rows.select(*keep).join(self.table, on=self.keys, how="inner").select(*keep, "feature", "value")
        return long_block(rows.select(*keep).join(self.wide, on=self.keys, how="inner"), self.names, keep)


def precompute_block(sub: FittedModel, rows: DataFrame, keys: list[str], name: str) -> PrecomputedBlock:
    wide = materialize(nbo.nb_probas(margins(sub, rows, keys), keys, sub.nb))
    names = [f"{name}:{c}" for c in sub.labels]
    return PrecomputedBlock(long_block(wide, names, keys), list(keys), len(sub.labels), wide, names)


def long_block(wide: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value) of rows with an array of probabilities."""
    every = F.array(*[F.lit(n) for n in names])
    return (wide.select(*keep, F.posexplode("probas").alias("_i", "value"))
                .select(*keep, every[F.col("_i")].alias("feature"), "value"))


def feature_table(fitted: FittedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """All feature blocks of ``df`` rows, in fitted vocabulary only."""
    prepped = _prep(df, fitted.spec)
    parts = [tfidf_features(fitted, prepped, keys)] + stacked_blocks(fitted, df, keys)
    parts += [long_block(wide, names, keys) for wide, names in lm_arrays(fitted, prepped, keys)]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x


def proba_block(sub: FittedModel, df: DataFrame, keys: list[str], name: str, lm: list | None = None) -> DataFrame:
    """Class probabilities of a fitted sub-model as features ``name:label``."""
    m = margins(sub, df, keys, lm)
    p = nbo.nb_proba(m, keys, sub.nb, label_out="_cls")
    return p.select(*keys, F.concat(F.lit(name + ":"), F.col("_cls")).alias("feature"),
                    F.col("proba").alias("value"))


def fit(spec: ModelSpec, train: DataFrame, keys: list[str],
        stacked: list | None = None, lm_train: DataFrame | None = None,
        reuse: FittedModel | None = None, finer: tuple | None = None) -> FittedModel:
    """Fit vocabularies (and LMs) then NB on ``train`` (which carries
    ``spec.label_col``). ``stacked`` = [(block name, fitted sub-model)]
    whose probabilities become features. ``reuse``: a model fitted on the
    same rows with the same spec whose vocabularies / LMs are taken as is
    (the ablation fits only the NB per configuration). ``finer``: (model, column of
    ``train``), a model of TF-IDF features alone fitted on the same rows and texts with
    that column as labels; where each of its labels has one label here, its
    vocabularies and added-up sums are taken, and no text is read."""
    fitted = FittedModel(spec=spec, keys=keys, stacked=list(stacked or []))
    tkeys = [*keys, spec.label_col]
    prepped = _prep(train.select(*tkeys, spec.text_col), spec)
    n_features = 0
    kinds = kinds_of(spec)
    # a model of the same rows and TF-IDF features alone has their sums already
    summed = reuse is not None and not reuse.lms and not reuse.stacked
    sums = coarser_sums(*finer, train, spec) if finer and reuse is None else None
    if not summed and sums is None:
        # the terms of the training rows' blocks are counted once and reused by
        # the vocabulary fit and the training feature values
        blocked = text_blocks(prepped, tkeys, TEXT, near=spec.label_col)
        asked = materialize(block_terms(blocked, kinds))
    if reuse is not None or sums is not None:
        fitted.vocabs = dict((reuse or finer[0]).vocabs)
        n_features += sum(known_rows(v) for v in fitted.vocabs.values())
    else:
        n_docs = train.count()
        for b in kinds:
            vocab = vocabulary(asked, b, n_docs)
            if spec.materialize:
                vocab = materialize(vocab)
            with_rows(vocab, vocab.count())
            fitted.vocabs[b] = vocab
            n_features += known_rows(vocab)
    if reuse is not None and reuse.lms:
        fitted.lms, fitted.lm_labels = reuse.lms, reuse.lm_labels
        n_features += 2 * len(fitted.lm_labels)
    elif spec.lm_order > 0:
        from ..operators.lm import fit_lms
        src = prepped if lm_train is None else _prep(lm_train, spec)
        src = src.where(~F.col(spec.label_col).isin(list(spec.lm_exclude))) if spec.lm_exclude else src
        fitted.lms, fitted.lm_labels = fit_lms(src, TEXT, spec.label_col,
                                               spec.lm_order, spec.materialize)
        n_features += 2 * len(fitted.lm_labels)
    for _, sub in fitted.stacked:
        n_features += len(sub.labels)
    x = (reuse.nb.stats.select(spec.label_col, "feature", F.col("S").alias("value")) if summed
         else sums if sums is not None
         else label_values(blocked, known(asked, fitted.vocabs), spec.label_col, kinds))
    for p in stacked_blocks(fitted, train.select(*tkeys, spec.text_col), tkeys):
        x = x.unionByName(p.select(spec.label_col, "feature", "value"))
    for wide, names in lm_arrays(fitted, prepped, tkeys):
        x = x.unionByName(nbo.array_label_values(wide, names, spec.label_col))
    docs = train.select(*keys, spec.label_col)
    fitted.nb = nbo.nb_fit(x, docs, spec.label_col, n_features, spec.materialize)
    return fitted


def coarser_sums(finer: FittedModel, column: str, train: DataFrame, spec: ModelSpec) -> DataFrame | None:
    """(label, feature, value) of TF-IDF features from the sums of a finer model; None
    where its features are others or a label of it has more than one label here."""
    own = finer.spec
    if (own.word, own.char, own.profile, own.text_col) != (spec.word, spec.char, spec.profile, spec.text_col) or finer.lms or finer.stacked:
        return None
    # a row for each class of the finer model
    pairs = materialize(train.select(F.col(column).alias("_fine"), F.col(spec.label_col)).distinct())
    if pairs.where("_fine IS NULL").count() or pairs.count() != pairs.select("_fine").distinct().count():
        return None
    stats = finer.nb.stats
    return (stats.select(F.col(stats.columns[0]).alias("_fine"), "feature", "S").join(F.broadcast(pairs), "_fine")
                 .select(spec.label_col, "feature", F.col("S").alias("value")))


def feature_sums(fitted: FittedModel, df: DataFrame, keys: list[str], lm: list | None = None) -> DataFrame:
    """(keys, _X, _Z, _D) of ``df`` rows: what ``nb_sums`` makes of
    ``feature_table``, with the TF-IDF blocks summed where they are formed. ``lm``:
    what ``lm_arrays`` gave for these rows, if it is there already."""
    df = df.select(*keys, fitted.spec.text_col)
    prepped = _prep(df, fitted.spec)
    kinds = kinds_of(fitted.spec)
    blocked = text_blocks(prepped, keys, TEXT, len(fitted.labels) + 1)
    sums = nbo.block_model_sums(blocked, block_terms(blocked, kinds), fitted.vocabs, kinds, keys, fitted.nb)
    extra = stacked_blocks(fitted, df, keys)
    if extra:
        sums = nbo.add_sums(sums, nbo.long_model_sums(reduce(DataFrame.unionByName, extra), keys, fitted.nb), keys)
    for wide, names in lm_arrays(fitted, prepped, keys) if lm is None else lm:
        sums = nbo.add_sums(sums, nbo.array_model_sums(wide, names, keys, fitted.nb), keys)
    return nbo.sums_of(df, sums, keys, len(fitted.labels))


def margins(fitted: FittedModel, df: DataFrame, keys: list[str], lm: list | None = None) -> DataFrame:
    return nbo.margins_of(feature_sums(fitted, df, keys, lm), keys, fitted.nb)


def predict(fitted: FittedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred) with the library's hard-prediction rule."""
    return nbo.nb_predict(margins(fitted, df, keys), keys, fitted.nb)


def predict_scores(fitted: FittedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction API: (keys, top, score, scores map)."""
    return nbo.nb_top(margins(fitted, df, keys), keys, fitted.nb)


def evaluate(fitted: FittedModel, df: DataFrame, keys: list[str],
             extra_by: list[str] = ("split",)) -> DataFrame:
    """Metrics per (extra_by, level) for the rows of ``df`` (gold in the
    label column)."""
    extra_by = list(extra_by)
    pred = predict(fitted, df, keys)
    gp = (df.select(*keys, *extra_by, F.col(fitted.spec.label_col).alias("gold"))
            .join(pred, on=keys, how="inner"))
    return levels_eval(gp, fitted.spec.level, extra_by=extra_by)


def with_spec(spec: ModelSpec, **kw) -> ModelSpec:
    return replace(spec, **kw)
