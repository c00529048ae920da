"""Fixture queries of the n-gram language models: counts, discounts,
Kneser-Ney tables, sentence scores, LM features; and the model with the LM
block added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import compose_label
from ..operators import lm as L
from . import corpus, model
from . import oracle_sql as O
from . import q_model
from .registry import register

KEYS = q_model.KEYS
ORDER = 3

# -- oracle ------------------------------------------------------------------------


def _unit_toks_sql(unit: str, text: str = "t") -> str:
    if unit == "word":
        return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"
    return (f"list_filter(string_split(replace({text}, ' ', 'X'), ''), "
            f"lambda c: regexp_full_match(c, '\\S'))")


def _gram_cols(order: int) -> str:
    """g1..gN: the n-grams that end at a position, by ``lag`` over the
    sentence's tokens (null where the sentence has fewer)."""
    def word(k):
        return f"lag(w, {k}) OVER s" if k else "w"
    return ", ".join(" || ' ' || ".join(word(k) for k in range(n - 1, -1, -1)) + f" AS g{n}"
                     for n in range(1, order + 1))


def lm_train_ctes(order: int, src: str = "tr") -> str:
    """CTEs ``probs``, ``backoffs``, ``unk``, ``disc`` from a relation
    ``src`` with (doc_id, line_no, label, t) where t is the profiled text.
    Tokens are exploded once, so the cost is linear in the text."""
    N = order
    parts = " UNION ALL ".join(
        f"SELECT '{u}' AS unit, doc_id, line_no, label, ['<s>'] || {_unit_toks_sql(u)} || ['</s>'] AS tk FROM {src}"
        for u in L.UNITS)
    grams = " UNION ALL ".join(
        f"SELECT unit, label, {n} AS n, g{n} AS gram, count(*) AS c FROM lmg WHERE e >= {max(n, 2)} GROUP BY ALL"
        for n in range(1, N + 1))
    ctes = f"""
lms AS ({parts}),
lme AS (SELECT unit, doc_id, line_no, label, unnest(tk) AS w, unnest(generate_series(1, len(tk))) AS e FROM lms),
lmg AS MATERIALIZED (SELECT unit, label, e, {_gram_cols(N)} FROM lme
        WINDOW s AS (PARTITION BY unit, doc_id, line_no ORDER BY e)),
counts AS MATERIALIZED ({grams}),
ext AS MATERIALIZED (SELECT unit, label, n - 1 AS n, regexp_replace(gram, '^[^ ]+ ', '') AS gram, count(*) AS a_ext
        FROM counts WHERE n >= 2 GROUP BY ALL),
adj AS MATERIALIZED (SELECT c.unit, c.label, c.n, c.gram, c.c,
               CASE WHEN c.n = {N} OR c.gram LIKE '<s> %' OR c.gram = '<s>' THEN c.c
                    ELSE coalesce(x.a_ext, 0) END AS a
        FROM counts c LEFT JOIN ext x USING (unit, label, n, gram)),
tt AS (SELECT unit, label, n,
              CAST(count(*) FILTER (WHERE a = 1) AS DOUBLE) AS t1, CAST(count(*) FILTER (WHERE a = 2) AS DOUBLE) AS t2,
              CAST(count(*) FILTER (WHERE a = 3) AS DOUBLE) AS t3, CAST(count(*) FILTER (WHERE a = 4) AS DOUBLE) AS t4
       FROM adj GROUP BY ALL),
rr AS (SELECT unit, label, n,
              1 - 2 * (t1 / nullif(t1 + 2 * t2, 0)) * t2 / nullif(t1, 0) AS r1,
              2 - 3 * (t1 / nullif(t1 + 2 * t2, 0)) * t3 / nullif(t2, 0) AS r2,
              3 - 4 * (t1 / nullif(t1 + 2 * t2, 0)) * t4 / nullif(t3, 0) AS r3
       FROM tt),
disc AS (SELECT unit, label, n,
                CASE WHEN ok THEN r1 ELSE {L.FALLBACK[0]} END AS d1,
                CASE WHEN ok THEN r2 ELSE {L.FALLBACK[1]} END AS d2,
                CASE WHEN ok THEN r3 ELSE {L.FALLBACK[2]} END AS d3
         FROM (SELECT *, coalesce(r1 BETWEEN 0 AND 1 AND r2 BETWEEN 0 AND 2 AND r3 BETWEEN 0 AND 3
                                  AND NOT isnan(r1) AND NOT isnan(r2) AND NOT isnan(r3), false) AS ok FROM rr)),
ad AS MATERIALIZED (SELECT a.*, CASE WHEN a.a = 1 THEN d.d1 WHEN a.a = 2 THEN d.d2 WHEN a.a >= 3 THEN d.d3 ELSE 0 END AS D,
              CASE WHEN a.n = 1 THEN '' ELSE regexp_replace(a.gram, ' [^ ]+$', '') END AS h
       FROM adj a JOIN disc d USING (unit, label, n)),
ctx AS MATERIALIZED (SELECT unit, label, n, h, sum(a) AS den, sum(D) AS dmass, sum(D) / sum(a) AS b FROM ad GROUP BY ALL),
uu AS MATERIALIZED (SELECT ad.unit, ad.label, ad.n, ad.gram, (ad.a - ad.D) / ctx.den AS u, ctx.b
       FROM ad JOIN ctx USING (unit, label, n, h)),
vs AS (SELECT unit, label, count(*) + 1 AS V FROM counts WHERE n = 1 GROUP BY ALL),
base AS MATERIALIZED (SELECT vs.unit, vs.label, vs.V, ctx.b AS b0 FROM vs JOIN ctx ON ctx.unit = vs.unit
         AND ctx.label = vs.label AND ctx.n = 1),
p1 AS MATERIALIZED (SELECT uu.unit, uu.label, uu.n, uu.gram, uu.u + base.b0 / base.V AS p
       FROM uu JOIN base USING (unit, label) WHERE uu.n = 1)"""
    prev = "p1"
    for n in range(2, N + 1):
        ctes += f""",
p{n} AS MATERIALIZED (SELECT uu.unit, uu.label, uu.n, uu.gram, uu.u + uu.b * lo.p AS p
        FROM uu JOIN {prev} lo ON lo.unit = uu.unit AND lo.label = uu.label
         AND lo.gram = regexp_replace(uu.gram, '^[^ ]+ ', '') WHERE uu.n = {n})"""
        prev = f"p{n}"
    union = " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, N + 1))
    ctes += f""",
probs AS (SELECT unit, label, n, gram, log10(p) AS logp FROM ({union})),
backoffs AS (SELECT unit, label, h AS gram, log10(b) AS logb FROM ctx WHERE h <> ''),
unk AS (SELECT unit, label, log10(b0 / V) AS logp_unk FROM base)"""
    return ctes


def _lm_sql(tail: str, order: int = ORDER, level: str = "city") -> str:
    return f"""
WITH {O.corpus_ctes()},
lab AS (SELECT *, {O.label_expr(level)} AS label, {O.profile_sql('original_sentence', 'agg')} AS t FROM sent),
tr AS (SELECT doc_id, line_no, label, t FROM lab WHERE split = 'train'),
ap AS (SELECT doc_id, line_no, split, label, t FROM lab WHERE split <> 'train'),
{lm_train_ctes(order)}
{tail}"""


def score_ctes(unit: str, order: int = ORDER, src: str = "ap", p: str = "") -> str:
    """CTE ``{p}scores``: per (keys, label) log10 sentence score under each
    label's LM, by the ARPA back-off rule, for the rows of ``src``. Every
    distinct window (a token with the at most N - 1 before it) is scored once
    per label."""
    N = order
    window = "coalesce(" + ", ".join(f"g{n}" for n in range(N, 0, -1)) + ")"
    grams = " UNION ALL ".join(
        f"SELECT DISTINCT k, {n} AS n, g{n} AS gram, "
        + (f"regexp_replace(g{n}, ' [^ ]+$', '')" if n > 1 else "CAST(NULL AS VARCHAR)")
        + f" AS h FROM {p}sg WHERE g{n} IS NOT NULL" for n in range(1, N + 1))
    return f"""
{p}sq AS (SELECT doc_id, line_no, ['<s>'] || {_unit_toks_sql(unit)} || ['</s>'] AS tk FROM {src}),
{p}se AS (SELECT doc_id, line_no, unnest(tk) AS w, unnest(generate_series(1, len(tk))) AS e FROM {p}sq),
{p}sg AS MATERIALIZED (SELECT *, {window} AS k
       FROM (SELECT doc_id, line_no, e, {_gram_cols(N)} FROM {p}se
             WINDOW s AS (PARTITION BY doc_id, line_no ORDER BY e)) WHERE e >= 2),
{p}wg AS MATERIALIZED ({grams}),
{p}hit AS (SELECT wg.k, p.label, max(wg.n) AS m, arg_max(p.logp, wg.n) AS lp
        FROM {p}wg wg JOIN probs p ON p.unit = '{unit}' AND p.n = wg.n AND p.gram = wg.gram GROUP BY ALL),
{p}kl AS MATERIALIZED (
  SELECT k.k, u.label, coalesce(hit.m, 0) AS m, coalesce(hit.lp, u.logp_unk) AS lp
  FROM (SELECT DISTINCT k FROM {p}sg) k CROSS JOIN (SELECT label, logp_unk FROM unk WHERE unit = '{unit}') u
  LEFT JOIN {p}hit hit ON hit.k = k.k AND hit.label = u.label),
{p}cb AS (SELECT wg.k, b.label, wg.n - 1 AS len, b.logb
       FROM {p}wg wg JOIN backoffs b ON b.unit = '{unit}' AND b.gram = wg.h),
{p}bo AS (SELECT kl.k, kl.label, sum(cb.logb) AS lb FROM {p}kl kl JOIN {p}cb cb ON cb.k = kl.k
       AND cb.label = kl.label AND cb.len >= greatest(kl.m, 1) GROUP BY ALL),
{p}ks AS MATERIALIZED (SELECT kl.k, kl.label, kl.lp + coalesce(bo.lb, 0) AS s
       FROM {p}kl kl LEFT JOIN {p}bo bo ON bo.k = kl.k AND bo.label = kl.label),
{p}scores AS (
  SELECT sg.doc_id, sg.line_no, ks.label, sum(ks.s) AS score
  FROM {p}sg sg JOIN {p}ks ks USING (k) GROUP BY ALL)"""


def feature_ctes(unit: str, p: str = "") -> str:
    """CTE ``{p}feat`` (keys, feature, value) from ``{p}scores``: exp of the
    scores, L2-normalised per sentence."""
    return f"""
{p}ex AS (SELECT doc_id, line_no, label, exp(score) AS e FROM {p}scores),
{p}nr AS (SELECT doc_id, line_no, sqrt(sum(e * e)) AS nrm FROM {p}ex GROUP BY ALL),
{p}feat AS (SELECT ex.doc_id, ex.line_no, 'l{unit[0]}:' || ex.label AS feature,
       CASE WHEN nr.nrm > 0 THEN ex.e / nr.nrm ELSE ex.e END AS value
FROM {p}ex ex JOIN {p}nr nr USING (doc_id, line_no))"""


# -- Spark side ----------------------------------------------------------------------
_LM: dict = {}


def lm_model(spark: SparkSession, sf_dir: str, order: int = ORDER, units: tuple = L.UNITS) -> L.LMModel:
    """Models of ``units`` (each unit's are its own), or of both if there are any."""
    key = (spark.sparkContext.applicationId, sf_dir, order)
    if key not in _LM and units != L.UNITS:
        key = (*key, units)
    if key not in _LM:
        s = q_model.sentences(spark, sf_dir).where("split = 'train'")
        prepped = model._prep(s, q_model.FULL)
        _LM[key] = L.fit_lms(prepped, model.TEXT, "label", order, units=units)[0]["lm"]
    return _LM[key]


def _sents(lines: DataFrame, units: tuple = L.UNITS) -> DataFrame:
    """(unit, label, toks) of lines with a label."""
    prepped = model._prep(lines, q_model.FULL)
    out = None
    for u in units:
        part = prepped.select(F.lit(u).alias("unit"), "label",
                              L.unit_tokens(F.col(model.TEXT), u).alias("toks"))
        out = part if out is None else out.unionByName(part)
    return out


def _train_sents(spark, sf_dir):
    return _sents(q_model.sentences(spark, sf_dir).where("split = 'train'"))


def _counts_sql(unit: str) -> str:
    """n-gram counts of the lines of every document."""
    return f"""
WITH {O.lines_ctes()},
tr AS (SELECT doc_id, line_no, {O.label_expr("city")} AS label, {O.profile_sql('original_sentence', 'agg')} AS t FROM sent),
{lm_train_ctes(ORDER)}
SELECT label, n, gram, c FROM counts WHERE unit = '{unit}'"""


def _counts(spark, sf_dir, unit: str) -> DataFrame:
    lines = corpus.all_lines(spark, sf_dir).withColumn("label", compose_label("city"))
    return L.ngram_counts(_sents(lines, (unit,)), ORDER).select("label", "n", "gram", "c")


@register("ngram_counts_word", _counts_sql("word"))
def q_ngram_counts_word(spark, sf_dir):
    """Counts of the word n-grams of every line, copies included: a count is no
    fit, so no split is drawn."""
    return _counts(spark, sf_dir, "word")


@register("ngram_counts_char", _counts_sql("char"))
def q_ngram_counts_char(spark, sf_dir):
    return _counts(spark, sf_dir, "char")


@register("kn_discounts", _lm_sql(
    "SELECT unit, label, n, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM disc"))
def q_kn_discounts(spark, sf_dir):
    d = L.sentence_discounts(_train_sents(spark, sf_dir), ORDER)
    return d.select("unit", "label", "n", *[F.round(f"d{k}", 6).alias(f"d{k}") for k in (1, 2, 3)])


@register("lm_train_order3", _lm_sql(
    "SELECT unit, label, n, gram, round(logp, 6) AS logp FROM probs"))
def q_lm_train_order3(spark, sf_dir):
    m = lm_model(spark, sf_dir, 3)
    return m.probs.select("unit", "label", "n", "gram", F.round("logp", 6).alias("logp"))


@register("lm_backoff_order3", _lm_sql(
    "SELECT unit, label, gram, round(logb, 6) AS logb FROM backoffs"))
def q_lm_backoff_order3(spark, sf_dir):
    m = lm_model(spark, sf_dir, 3)
    return m.backoffs.select("unit", "label", "gram", F.round("logb", 6).alias("logb"))


@register("lm_train_order2", _lm_sql(
    "SELECT unit, label, n, gram, round(logp, 6) AS logp FROM probs", order=2))
def q_lm_train_order2(spark, sf_dir):
    m = lm_model(spark, sf_dir, 2)
    return m.probs.select("unit", "label", "n", "gram", F.round("logp", 6).alias("logp"))


def _score(spark, sf_dir, unit):
    m = lm_model(spark, sf_dir, ORDER, (unit,))
    s = q_model.sentences(spark, sf_dir).where("split <> 'train'")
    prepped = model._prep(s, q_model.FULL)
    sc = L.score(m, prepped, KEYS, unit, L.unit_tokens(F.col(model.TEXT), unit))
    lab = F.array(*[F.lit(x) for x in m.labels])
    return (sc.select(*KEYS, F.posexplode("scores").alias("_i", "score"))
              .select(*KEYS, lab[F.col("_i")].alias("label"), F.round("score", 6).alias("score")))


@register("lm_score_word", _lm_sql("," + score_ctes("word")
                                   + "\nSELECT doc_id, line_no, label, round(score, 6) AS score FROM scores"))
def q_lm_score_word(spark, sf_dir):
    """log10 P(sentence) under every label's word LM (order 3), with <s>
    and </s>, for the dev and test sentences."""
    return _score(spark, sf_dir, "word")


@register("lm_score_char", _lm_sql("," + score_ctes("char")
                                   + "\nSELECT doc_id, line_no, label, round(score, 6) AS score FROM scores"))
def q_lm_score_char(spark, sf_dir):
    """log10 P(char stream) under every label's char LM (order 3) for the
    dev and test sentences (also checked against a brute-force scorer in
    tests)."""
    return _score(spark, sf_dir, "char")


LM_SPEC = model.ModelSpec(lm_order=ORDER)


def _eval_lm_sql() -> str:
    """The flagship model with the two LM feature blocks, in SQL: the LMs of
    the train rows score every sentence, the features join the TF-IDF ones."""
    head = O.model_sql(lm_blocks=("w_", "c_"), lm_ctes=",\n".join(
        [lm_train_ctes(ORDER).strip()] + [part.strip() for u in L.UNITS for part in
                                          (score_ctes(u, src="lab", p=u[0] + "_"), feature_ctes(u, u[0] + "_"))]))
    return head + O.levels_ctes("SELECT * FROM gp", "city", "split").strip() + "\nSELECT * FROM metrics"


@register("eval_lm", _eval_lm_sql())
def q_eval_lm(spark, sf_dir):
    """Model with the LM feature block (word + char TF-IDF, word/char LM
    scores exp-L2-normalised per unit) -> NB -> metrics per level."""
    fm = q_model.fitted(spark, sf_dir, LM_SPEC)
    s = q_model.sentences(spark, sf_dir).where("split <> 'train'")
    return q_model.round_metrics(model.evaluate(fm, s, KEYS))


def _lm_features(spark, sf_dir, unit: str) -> DataFrame:
    m = lm_model(spark, sf_dir, ORDER, (unit,))
    s = q_model.sentences(spark, sf_dir).where("split <> 'train'")
    prepped = model._prep(s, q_model.FULL)
    wide = L.features(m, prepped, KEYS, unit, L.unit_tokens(F.col(model.TEXT), unit))
    v = model.long_block(wide, [f"l{unit[0]}:{x}" for x in m.labels], KEYS)
    return v.select(*KEYS, "feature", F.round("value", 6).alias("value"))


def _features_sql(unit: str) -> str:
    return _lm_sql("," + score_ctes(unit) + "," + feature_ctes(unit)
                   + "\nSELECT doc_id, line_no, feature, round(value, 6) AS value FROM feat")


@register("lm_features_word", _features_sql("word"))
def q_lm_features_word(spark, sf_dir):
    """LM feature block of the word unit: exp of the log10 sentence scores,
    L2-normalised over labels (underflow gives an all-zero row)."""
    return _lm_features(spark, sf_dir, "word")


@register("lm_features_char", _features_sql("char"))
def q_lm_features_char(spark, sf_dir):
    """LM feature block of the char unit."""
    return _lm_features(spark, sf_dir, "char")


@register("lm_train_order5", _lm_sql(
    "SELECT unit, label, n, gram, round(logp, 6) AS logp FROM probs", order=5))
def q_lm_train_order5(spark, sf_dir):
    """The order the reference trains with."""
    m = lm_model(spark, sf_dir, 5)
    return m.probs.select("unit", "label", "n", "gram", F.round("logp", 6).alias("logp"))
