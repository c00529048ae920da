"""Toxicity scores: gradient-boosted trees over dense features, calibrated by
isotonic regression.

Three disjoint folds of the learning rows (by a hash of the id):
* lexicon: document frequencies of words and of word beginnings (4-6 letters)
  in rows labelled 1 and 0 (at most MAX_LEXICON_ROWS); terms whose log odds
  stand ``z`` standard errors above zero form tiers of a lexicon;
* trees: boosted trees on the features of the fold's labelled rows;
* calibration: isotonic regression of the labels on the trees' probability.

Features are rates per word or character: lexicon tiers, lexicon words next
to second-person pronouns, capitals, punctuation, obfuscation (digits or
signs inside words, letters repeated or spaced out). Labels, language, source
and id are never among them.

Null and empty texts have all-zero features and get the score of those. A
document with several labels counts as 1 if one of them is. If the folds lack
rows of either label, every score is the share of label 1 among learning rows
(0 without any).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenRows, in_arrow, materialize, text_slices, tokens

#: Second-person pronouns of English, German, French, Spanish,
#: Italian and Portuguese.
SECOND_PERSON = frozenset("""you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch
euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra ti tuo tua voi vostro
você vocês seu sua""".split())
TIERS = (2.5, 3.5, 5.0)
#: At most so many lexicon terms, by strength: what is broadcast is bounded.
MAX_TERMS = 50_000
#: At most so many labelled rows (the smallest hashes of the id) fit trees and calibration each.
MAX_FIT_ROWS = 200_000
#: At most about so many labelled rows (by the hash of the id) teach the lexicon: two numbers each, broadcast.
MAX_LEXICON_ROWS = 500_000
NEAR = 4

_LETTERS = regex.compile(r"\p{L}+")
_INSIDE = regex.compile(r"\p{L}[\p{N}@$!*#|+]+\p{L}")
_REPEAT = regex.compile(r"(\p{L})\1\1")
FEATURES = [f"{kind}_{i}" for kind in ("word", "stem") for i in range(len(TIERS))] + [
    "strength", "strongest", "second_person", "aimed", "capitals", "shouted", "exclaimed", "asked", "punctuation",
    "inside", "repeated", "single", "log_words"]


def stems(word: str) -> list[str]:
    return [word[:n] + "~" for n in (4, 5, 6) if len(word) >= n]


def terms(token: str) -> list[str]:
    out = []
    for word in _LETTERS.findall(token.lower()):
        out.append(word)
        out += stems(word)
    return out


def _frequencies(batches):
    for batch in batches:
        rows: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows[toxic].update({t for token in set(text.split()) for t in terms(token)})
        keys = list(rows[0].keys() | rows[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([rows[0][k] for k in keys], pa.int64()),
             pa.array([rows[1][k] for k in keys], pa.int64())], names=["term", "clean", "toxic"])


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """term -> z of its log odds, from (text, toxic) rows without nulls."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    df = (in_arrow(labelled.select("text", "toxic"), _frequencies, "term string, clean long, toxic long")
                  .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = (df.where("toxic >= 3").withColumn("z", odds / error).where(F.col("z") >= TIERS[0])
             .orderBy(F.desc("z"), "term").limit(MAX_TERMS))
    return {r["term"]: r["z"] for r in top.collect()}


def _holds(pattern: regex.Pattern, found: list[str]) -> np.ndarray:
    """Which tokens (without blanks) hold a pattern (without blanks): one search over all."""
    ends = np.cumsum([len(t) + 1 for t in found])
    out = np.zeros(len(found), bool)
    out[np.searchsorted(ends, [m.start() for m in pattern.finditer("\n".join(found))], "right")] = True
    return out


class Scorer:
    """Features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.rows = lexicon, TokenRows(16, make_all=self.tokens)
        self.heads = {t[:4] for t in lexicon if t[-1] == "~"}  # what any beginning in the lexicon starts with

    def stem(self, low: str) -> float:
        """The largest z of a word's beginnings."""
        return max([self.lexicon.get(t, 0.0) for t in stems(low)], default=0.0)

    def tokens(self, made: list[str]) -> np.ndarray:
        """Each token's share in the sums; last two columns: is it in the
        lexicon, does it speak to someone."""
        out = np.zeros((len(made), 16))
        lows = [token.lower() for token in made]
        words = [[t] if t.isalpha() else _LETTERS.findall(t) for t in made]
        count = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        if flat:
            low, get, heads = [w.lower() for w in flat], self.lexicon.get, self.heads
            z, s = np.array([get(w, 0.0) for w in low]), np.array([self.stem(w) if w[:4] in heads else 0.0 for w in low])
            shouted = [w.isupper() and len(w) > 2 for w in flat]
            each = np.column_stack([*(z >= t for t in TIERS), *(s >= t for t in TIERS), np.maximum(z, s), shouted,
                                    np.array(list(map(len, flat))) == 1, list(map(SECOND_PERSON.__contains__, low))])
            some, first = count > 0, (np.cumsum(count) - count)[count > 0]
            total = np.add.reduceat(each, first, axis=0)
            out[some, :7], out[some, 8:10] = total[:, :7], total[:, 7:9]
            out[some, 7] = np.maximum.reduceat(each[:, 6], first)
            out[:, 15][some] = total[:, 9] > 0
        out[:, 10] = [0 if t == low else sum(map(str.isupper, t)) for t, low in zip(made, lows, strict=True)]
        out[:, 11], out[:, 12] = _holds(_INSIDE, made), _holds(_REPEAT, lows)
        out[:, 13] = count
        out[:, 14] = out[:, 7] >= TIERS[1]
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """One row of features per text of a string column."""
        if not len(texts):
            return np.zeros((0, len(FEATURES)))
        texts = texts.cast(pa.large_string()).fill_null("")
        found, codes, ends = tokens(texts)
        rows = self.rows(found)
        each, first = rows[:, :14][codes], ends[:-1]
        total, strongest = np.add.reduceat(each, first, axis=0), np.maximum.reduceat(each[:, 7], first)
        row = np.repeat(np.arange(len(first)), np.diff(ends))
        place = np.arange(len(codes)) + row * (NEAR + 1)  # texts are more than NEAR apart
        is_bad, is_you = rows[:, 14][codes] > 0, rows[:, 15][codes] > 0
        bad, you = place[is_bad], place[is_you]
        aimed = np.zeros(len(first))
        if len(you) and len(bad):
            at = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
            aimed = np.bincount(row[is_bad][gap <= NEAR], minlength=len(first))
        second = np.bincount(row[is_you], minlength=len(first))
        marks = {m: pc.count_substring(texts, m).to_numpy(zero_copy_only=False) for m in "!?.,;:"}
        n, chars = np.maximum(1.0, total[:, 13]), np.maximum(1, pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        return np.column_stack([
            total[:, :6] / n[:, None], total[:, 6] / n, strongest, second / n, aimed / n, total[:, 10] / chars,
            total[:, 8] / n, marks["!"] / n, marks["?"] / n, (marks["."] + marks[","] + marks[";"] + marks[":"]) / n,
            total[:, 11] / n, total[:, 12] / n, total[:, 9] / n, np.log1p(total[:, 13])])


def features(docs: DataFrame, terms_of: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double per name in FEATURES, per row."""
    shared = docs.sparkSession.sparkContext.broadcast(terms_of)  # at most MAX_TERMS entries

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = scorer.features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)],
                                                 names=["doc_id", *FEATURES])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def score(docs: DataFrame, labels: DataFrame, learn, fold, doc_id: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> DataFrame:
    """(doc_id, score) per row of ``docs``. ``learn``: Column over doc_id,
    whether its label may be learned from. ``fold``: Column over doc_id, 0 to
    3: 0 and 1 teach the lexicon, 2 the trees, 3 the calibration."""
    known = materialize(labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1))
                        .groupBy(F.col(doc_id).cast("long").alias("doc_id"))
                        .agg(F.max(F.col(toxic).cast("int")).alias("toxic")).where(learn)
                        .withColumn("fold", fold))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    by_hash = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * 1.0 / (1 << 30)
    teachers = known.where("fold < 2")
    teachers = teachers.where(by_hash < MAX_LEXICON_ROWS / max(1, teachers.count())).select("doc_id", "toxic")
    taught = rows.join(F.broadcast(teachers), "doc_id").select("text", "toxic")
    table = materialize(features(rows, lexicon(taught)))
    fit = table.join(known.where("fold >= 2"), "doc_id")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in fit.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    if any(not sizes.get((f, y)) for f in (2, 3) for y in (0, 1)):
        share = known.agg(F.avg("toxic").alias("s")).first()["s"] or 0.0
        return table.select("doc_id", F.lit(float(share)).alias("score"))
    total = {f: sizes[f, 0] + sizes[f, 1] for f in (2, 3)}
    bound = F.when(F.col("fold") == 2, MAX_FIT_ROWS / total[2]).otherwise(MAX_FIT_ROWS / total[3])
    wide = VectorAssembler(inputCols=FEATURES, outputCol="x")
    fit = materialize(wide.transform(fit.where(by_hash < bound)).select("fold", F.col("toxic").cast("double"), "x"))
    trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=15, maxDepth=4, stepSize=0.3,
                          seed=7).fit(fit.where("fold = 2"))
    raw = lambda d: trees.transform(d).withColumn("s", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="s", labelCol="toxic", predictionCol="score").fit(
        raw(fit.where("fold = 3")).select("s", "toxic"))
    out = steps.transform(raw(wide.transform(table)).select("doc_id", "s"))
    return out.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
