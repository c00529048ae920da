"""Independent SQL (DuckDB dialect) for the registered queries.

These strings are the correctness oracle: written directly from the
semantics (not generated from the Spark plans) and run by DuckDB on the same
parquet tables. Shared pieces are CTE fragments.
"""

from __future__ import annotations

from ..functions.text import ARABIC_MARKS, TOKEN_PATTERN

NL = "chr(10)"


def corpus_ctes(train: float = 0.8, dev: float = 0.1, seed: int = 999) -> str:
    """CTEs ``ddocs`` (de-duplicated documents), ``splits`` and ``sent``
    (one row per non-blank line with its labels)."""
    return f"""
docs AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL),
keep AS (SELECT min(doc_id) AS doc_id FROM docs GROUP BY text),
ddocs AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM keep)),
ranked AS (
  SELECT doc_id,
         row_number() OVER (ORDER BY md5('{seed}' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk,
         count(*) OVER () AS n
  FROM ddocs),
splits AS (
  SELECT doc_id,
         CASE WHEN rk < floor(CAST({train} AS DOUBLE) * n) THEN 'train'
              WHEN rk < floor(CAST({train} AS DOUBLE) * n) + floor(CAST({dev} AS DOUBLE) * n) THEN 'dev'
              ELSE 'test' END AS split
  FROM ranked),
lines AS (
  SELECT doc_id, lang, source,
         unnest(string_split(text, {NL})) AS original_sentence,
         generate_subscripts(string_split(text, {NL}), 1) - 1 AS line_no
  FROM ddocs),
sent AS (
  SELECT l.doc_id, l.line_no, s.split, l.original_sentence,
         l.source AS dialect_city_id, CAST(NULL AS VARCHAR) AS dialect_province_id,
         l.lang AS dialect_country_id,
         CASE WHEN l.lang IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS dialect_region_id
  FROM lines l JOIN splits s USING (doc_id)
  WHERE trim(l.original_sentence) <> '')"""


def lines_ctes() -> str:
    """CTEs ``docs`` and ``sent``: one row per non-blank line of every
    document (copies included) with its labels."""
    return f"""
docs AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, lang, source,
         unnest(string_split(text, {NL})) AS original_sentence,
         generate_subscripts(string_split(text, {NL}), 1) - 1 AS line_no
  FROM docs),
sent AS (
  SELECT doc_id, line_no, original_sentence,
         source AS dialect_city_id, CAST(NULL AS VARCHAR) AS dialect_province_id,
         lang AS dialect_country_id,
         CASE WHEN lang IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS dialect_region_id
  FROM lines WHERE trim(original_sentence) <> '')"""


def label_expr(level: str, prefix: str = "") -> str:
    cols = {"city": ["dialect_city_id", "dialect_country_id", "dialect_region_id"],
            "country": ["dialect_country_id", "dialect_region_id"],
            "region": ["dialect_region_id"]}[level]
    return " || '-' || ".join(f"coalesce({prefix}{c}, 'nan')" for c in cols)


def profile_sql(col: str, profile: str) -> str:
    if profile == "raw":
        return col
    inner = col if profile == "tok" else f"regexp_replace({col}, '{ARABIC_MARKS}', '', 'g')"
    return f"array_to_string(regexp_extract_all({inner}, '{TOKEN_PATTERN}', 1), ' ')"


def word_terms_sql(src: str, text: str = "t") -> str:
    """(doc_id, line_no, [label,] term) rows of word unigrams over split(' ')."""
    return f"SELECT *, unnest(string_split({text}, ' ')) AS term FROM {src}"


def char_terms_sql(src: str, lo: int = 1, hi: int = 3, text: str = "t") -> str:
    """Character n-grams lo..hi after collapsing whitespace runs."""
    parts = []
    for n in range(lo, hi + 1):
        parts.append(
            f"SELECT * EXCLUDE (ct, i), substring(ct, i, {n}) AS term FROM ("
            f"SELECT *, regexp_replace({text}, '\\s\\s+', ' ', 'g') AS ct, "
            f"unnest(generate_series(1, length(regexp_replace({text}, '\\s\\s+', ' ', 'g')) - {n} + 1)) AS i "
            f"FROM {src}) WHERE length(ct) >= {n}")
    return " UNION ALL ".join(parts)


def tfidf_ctes(block: str, terms_sql_train: str, terms_sql_apply: str | None, n_train: str,
               keys: str = "doc_id, line_no") -> str:
    """CTEs ``vocab_{b}``, ``x_{b}_tr`` and (if an apply set is given)
    ``x_{b}_ap``: normalised (keys, feature, value). ``n_train`` is a
    scalar subquery."""
    b = block

    def norm(tf: str) -> str:
        return (f"SELECT {keys}, '{b}:' || term AS feature, "
                f"w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS value "
                f"FROM (SELECT a.*, a.tf * v.idf AS w FROM {tf} a JOIN vocab_{b} v USING (term))")
    out = f"""
tf_{b}_fit AS (SELECT {keys}, term, count(*) AS tf FROM ({terms_sql_train}) GROUP BY ALL),
vocab_{b} AS (
  SELECT term, count(*) AS df,
         ln((1.0 + ({n_train})) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf_{b}_fit GROUP BY term),
x_{b}_tr AS ({norm(f"tf_{b}_fit")})"""
    if terms_sql_apply is not None:
        out += f""",
tf_{b}_app AS (SELECT {keys}, term, count(*) AS tf FROM ({terms_sql_apply}) GROUP BY ALL),
x_{b}_ap AS ({norm(f"tf_{b}_app")})"""
    return out


def nb_ctes(x_train: str, train_docs: str, x_apply: str, apply_docs: str,
            n_features: str, keys: str = "doc_id, line_no", p: str = "") -> str:
    """CTEs ``{p}cls`` (label, n_c, S_c, b, k), ``{p}margins`` / ``{p}post``
    (keys, label, margin / p) and ``{p}pred`` (keys, pred) for the apply
    documents. x_* have (keys[, label], feature, value); *_docs have
    (keys[, label]). ``p`` prefixes every CTE name."""
    ks = [k.strip() for k in keys.split(",")]

    def q(alias):
        return ", ".join(f"{alias}.{k}" for k in ks)
    dd_on = " AND ".join(f"dd.{k} = a.{k}" for k in ks)
    return f"""
{p}S AS (SELECT label, feature, sum(value) AS S FROM ({x_train}) GROUP BY label, feature HAVING sum(value) > 0),
{p}Tf AS (SELECT feature, sum(S) AS T_f FROM {p}S GROUP BY feature),
{p}Sc AS (SELECT label, sum(S) AS S_c FROM {p}S GROUP BY label),
{p}ncls AS (SELECT label, count(*) AS n_c FROM ({train_docs}) GROUP BY label),
{p}tot AS (SELECT (SELECT sum(n_c) FROM {p}ncls) AS n, (SELECT sum(S_c) FROM {p}Sc) AS T, ({n_features}) AS F),
{p}cls AS (
  SELECT c.label, c.n_c, coalesce(s.S_c, 0) AS S_c,
         ln(c.n_c / (t.n - c.n_c)) AS b,
         ln(t.T - coalesce(s.S_c, 0) + t.F) - ln(coalesce(s.S_c, 0) + t.F) AS k
  FROM {p}ncls c LEFT JOIN {p}Sc s USING (label), {p}tot t),
{p}delta AS (
  SELECT s.label, s.feature, ln(s.S + 1) - ln(tf.T_f - s.S + 1) + ln(tf.T_f + 1) AS d
  FROM {p}S s JOIN {p}Tf tf USING (feature)),
{p}xa AS (SELECT {keys}, feature, value FROM ({x_apply})),
{p}dx AS (SELECT {keys}, sum(value) AS X FROM {p}xa GROUP BY ALL),
{p}dz AS (SELECT {q("xa")}, sum(xa.value * ln(tf.T_f + 1)) AS Z
       FROM {p}xa xa JOIN {p}Tf tf USING (feature) GROUP BY ALL),
{p}dd AS (SELECT {q("xa")}, de.label, sum(xa.value * de.d) AS D
       FROM {p}xa xa JOIN {p}delta de USING (feature) GROUP BY ALL),
{p}adocs AS (SELECT DISTINCT {keys} FROM ({apply_docs})),
{p}margins AS (
  SELECT {q("a")}, c.label,
         c.b + c.k * coalesce(dx.X, 0) - coalesce(dz.Z, 0) + coalesce(dd.D, 0) AS margin
  FROM {p}adocs a CROSS JOIN {p}cls c
  LEFT JOIN {p}dx dx USING ({keys})
  LEFT JOIN {p}dz dz USING ({keys})
  LEFT JOIN {p}dd dd ON {dd_on} AND dd.label = c.label),
{p}nclass AS (SELECT count(*) AS K FROM {p}cls),
{p}post AS (SELECT *, 1.0 / (1.0 + exp(-margin)) AS p FROM {p}margins),
{p}pred AS (
  SELECT {keys}, label AS pred FROM (
    SELECT po.*, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, label DESC) AS rn
    FROM {p}post po) WHERE rn = 1 AND (SELECT K FROM {p}nclass) > 2
  UNION ALL
  SELECT {keys},
         CASE WHEN max(CASE WHEN label = (SELECT max(label) FROM {p}cls) THEN p END) > 0.5
              THEN (SELECT max(label) FROM {p}cls) ELSE (SELECT min(label) FROM {p}cls) END AS pred
  FROM {p}post WHERE (SELECT K FROM {p}nclass) = 2 GROUP BY ALL)"""


def levels_ctes(gp: str, level: str = "city", by: str = "split", p: str = "") -> str:
    """CTE ``metrics`` (by, level, n_rows, seven metrics rounded to 6)
    from a (by, gold, pred) relation."""
    sel = []
    if level == "city":
        sel.append(f"SELECT {by}, 'city' AS level, gold, pred FROM ({gp})")
        sel.append(f"SELECT {by}, 'country', array_to_string(string_split(gold, '-')[2:], '-'), "
                   f"array_to_string(string_split(pred, '-')[2:], '-') FROM ({gp})")
        sel.append(f"SELECT {by}, 'region', string_split(gold, '-')[3], string_split(pred, '-')[3] FROM ({gp})")
    elif level == "country":
        sel.append(f"SELECT {by}, 'country' AS level, gold, pred FROM ({gp})")
        sel.append(f"SELECT {by}, 'region', string_split(gold, '-')[2], string_split(pred, '-')[2] FROM ({gp})")
    else:
        sel.append(f"SELECT {by}, 'region' AS level, gold, pred FROM ({gp})")
    return f"""
{p}lv AS ({' UNION ALL '.join(sel)}),
{p}conf AS (SELECT {by}, level, gold, pred, count(*) AS n FROM {p}lv GROUP BY ALL),
{p}ltot AS (SELECT {by}, level, sum(n) AS n_rows,
               sum(CASE WHEN gold IS NOT DISTINCT FROM pred THEN n ELSE 0 END) AS n_correct
        FROM {p}conf GROUP BY ALL),
{p}pg AS (SELECT {by}, level, gold AS label,
              sum(CASE WHEN gold IS NOT DISTINCT FROM pred THEN n ELSE 0 END) AS tp, sum(n) AS gold_n
       FROM {p}conf GROUP BY ALL),
{p}pp AS (SELECT {by}, level, pred AS label, sum(n) AS pred_n FROM {p}conf GROUP BY ALL),
{p}per AS (
  SELECT coalesce(pg.{by}, pp.{by}) AS {by}, coalesce(pg.level, pp.level) AS level,
         coalesce(tp, 0) AS tp, coalesce(gold_n, 0) AS gold_n, coalesce(pred_n, 0) AS pred_n
  FROM {p}pg pg FULL OUTER JOIN {p}pp pp
    ON pg.{by} = pp.{by} AND pg.level = pp.level AND pg.label IS NOT DISTINCT FROM pp.label),
{p}per2 AS (
  SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS p,
            CASE WHEN gold_n > 0 THEN tp / gold_n ELSE 0.0 END AS r
  FROM {p}per),
{p}per3 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM {p}per2),
{p}macro AS (SELECT {by}, level, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro
          FROM {p}per3 GROUP BY ALL),
{p}metrics AS (
  SELECT t.{by}, t.level, CAST(t.n_rows AS BIGINT) AS n_rows,
         round(CAST(t.n_correct AS DOUBLE) / t.n_rows, 6) AS accuracy,
         round(CAST(t.n_correct AS DOUBLE) / t.n_rows, 6) AS f1_micro,
         round(m.f1_macro, 6) AS f1_macro,
         round(CAST(t.n_correct AS DOUBLE) / t.n_rows, 6) AS recall_micro,
         round(m.recall_macro, 6) AS recall_macro,
         round(CAST(t.n_correct AS DOUBLE) / t.n_rows, 6) AS precision_micro,
         round(m.precision_macro, 6) AS precision_macro
  FROM {p}ltot t JOIN {p}macro m USING ({by}, level))"""


def levels_ctes_tail(gp: str, level: str, by: str = "split") -> str:
    """Extra metrics CTEs appended to an open WITH list, then the SELECT."""
    return "," + levels_ctes(gp, level, by, "m2_") + "\nSELECT * FROM m2_metrics"


def proba_ctes(p: str, keys: str = "doc_id, line_no") -> str:
    """CTE ``{p}proba`` (keys, label, proba): posteriors normalised to sum
    1; with two classes [1 - p, p] of the single estimator."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"p1.{k} = po.{k}" for k in ks)
    return f"""
{p}p1 AS (SELECT {keys}, p FROM {p}post WHERE label = (SELECT max(label) FROM {p}cls)),
{p}proba AS (
  SELECT {", ".join("po." + k for k in ks)}, po.label,
    CASE WHEN (SELECT K FROM {p}nclass) = 2
         THEN (CASE WHEN po.label = (SELECT max(label) FROM {p}cls) THEN p1.p ELSE 1 - p1.p END)
              / ((1 - p1.p) + p1.p)
         ELSE po.p / sum(po.p) OVER (PARTITION BY {", ".join("po." + k for k in ks)}) END AS proba
  FROM {p}post po LEFT JOIN {p}p1 p1 ON {on})"""


def submodel_ctes(p: str, train_rel: str, apply_rel: str, feature_prefix: str,
                  word: bool = True, char: bool = True, lm: str = "", lm_feats: tuple = ()) -> str:
    """A fitted sub-model (own TF-IDF + NB) applied to ``apply_rel``;
    emits CTE ``{p}block`` (doc_id, line_no, feature, value) of class
    probabilities named ``feature_prefix:label``. Relations have (doc_id,
    line_no, [label,] t). ``lm`` has CTEs over ``{p}tr`` and ``{p}ap`` that make
    the relations ``lm_feats``, its LM features."""
    parts = [f"{p}tr AS (SELECT * FROM {train_rel})", f"{p}ap AS (SELECT * FROM {apply_rel})",
             f"{p}ntr AS (SELECT count(*) AS n FROM {p}tr)"]
    bl = []
    if word:
        parts.append(tfidf_ctes(f"{p}w", word_terms_sql(f"{p}tr"), word_terms_sql(f"{p}ap"),
                                f"SELECT n FROM {p}ntr").strip())
        bl.append(f"{p}w")
    if char:
        parts.append(tfidf_ctes(f"{p}c", char_terms_sql(f"{p}tr"), char_terms_sql(f"{p}ap"),
                                f"SELECT n FROM {p}ntr").strip())
        bl.append(f"{p}c")
    if lm:
        parts.append(lm.strip())
    xtr = " UNION ALL ".join([f"SELECT * FROM x_{b}_tr" for b in bl]
                             + [f"SELECT f.* FROM {f} f SEMI JOIN {p}tr USING (doc_id, line_no)" for f in lm_feats])
    xap = " UNION ALL ".join([f"SELECT * FROM x_{b}_ap" for b in bl]
                             + [f"SELECT f.* FROM {f} f SEMI JOIN {p}ap USING (doc_id, line_no)" for f in lm_feats])
    nf = " + ".join([f"(SELECT count(*) FROM vocab_{b})" for b in bl] + [f"(SELECT count(DISTINCT feature) FROM {f})" for f in lm_feats])
    parts.append(f"{p}xtr AS (SELECT x.*, t.label FROM ({xtr}) x JOIN {p}tr t USING (doc_id, line_no))")
    parts.append(f"{p}xap AS ({xap})")
    parts.append(nb_ctes(f"SELECT * FROM {p}xtr", f"SELECT doc_id, line_no, label FROM {p}tr",
                         f"SELECT * FROM {p}xap", f"SELECT doc_id, line_no FROM {p}ap", nf,
                         p=p).strip())
    parts.append(proba_ctes(p).strip())
    parts.append(f"{p}block AS (SELECT doc_id, line_no, '{feature_prefix}:' || label AS feature, proba AS value "
                 f"FROM {p}proba)")
    return ",\n".join(parts)


def model_sql(level: str = "city", word: bool = True, char: bool = True, profile: str = "agg",
              train_where: str = "split = 'train'", apply_where: str = "split <> 'train'",
              extra: bool = False, layers: tuple = (), lm_blocks: tuple = (), lm_ctes: str = "",
              blocks_ctes: str = "", more_blocks: tuple = ()) -> str:
    """Whole fit + apply as CTEs up to ``pred``/``post`` and ``gp`` (split,
    gold, pred); callers append the final CTEs / SELECT. ``lm_ctes`` has the
    CTEs of LM features: ``{p}feat`` for each prefix of ``lm_blocks``;
    ``blocks_ctes`` those of further feature relations: ``more_blocks`` has
    (relation of the train rows, of the apply rows, number of features)."""
    blocks = []
    if word:
        blocks.append(tfidf_ctes("w", word_terms_sql("tr"), word_terms_sql("ap"), "SELECT n FROM ntr"))
    if char:
        blocks.append(tfidf_ctes("c", char_terms_sql("tr"), char_terms_sql("ap"), "SELECT n FROM ntr"))
    bl = [b for b, on in (("w", word), ("c", char)) if on]
    xtr = [f"SELECT * FROM x_{b}_tr" for b in bl]
    xap = [f"SELECT * FROM x_{b}_ap" for b in bl]
    nf = [f"(SELECT count(*) FROM vocab_{b})" for b in bl]
    subs = []
    allrel = "(SELECT doc_id, line_no, t FROM tr UNION ALL SELECT doc_id, line_no, t FROM ap)"
    if extra:
        subs.append(submodel_ctes(
            "e_", "(SELECT conv_id AS doc_id, turn AS line_no, role AS label, "
                  f"{profile_sql('text', profile)} AS t FROM conversations WHERE text IS NOT NULL)",
            allrel, "x"))
        xtr.append("SELECT b.* FROM e_block b SEMI JOIN tr USING (doc_id, line_no)")
        xap.append("SELECT b.* FROM e_block b SEMI JOIN ap USING (doc_id, line_no)")
        nf.append("(SELECT count(*) FROM e_cls)")
    for i, lv in enumerate(layers):
        p = f"l{i}_"
        subs.append(submodel_ctes(
            p, f"(SELECT doc_id, line_no, {label_expr(lv)} AS label, t FROM lab WHERE {train_where})",
            allrel, f"L{i}"))
        xtr.append(f"SELECT b.* FROM {p}block b SEMI JOIN tr USING (doc_id, line_no)")
        xap.append(f"SELECT b.* FROM {p}block b SEMI JOIN ap USING (doc_id, line_no)")
        nf.append(f"(SELECT count(*) FROM {p}cls)")
    if lm_ctes:
        subs.append(lm_ctes)
    for p in lm_blocks:
        xtr.append(f"SELECT b.* FROM {p}feat b SEMI JOIN tr USING (doc_id, line_no)")
        xap.append(f"SELECT b.* FROM {p}feat b SEMI JOIN ap USING (doc_id, line_no)")
        nf.append("(SELECT count(DISTINCT label) FROM tr)")
    if blocks_ctes:
        subs.append(blocks_ctes)
    for tr_rel, ap_rel, n in more_blocks:
        xtr.append(f"SELECT b.* FROM {tr_rel} b SEMI JOIN tr USING (doc_id, line_no)")
        xap.append(f"SELECT b.* FROM {ap_rel} b SEMI JOIN ap USING (doc_id, line_no)")
        nf.append(f"({n})")
    sub_sql = ("," + ",".join(subs)) if subs else ""
    return f"""
WITH {corpus_ctes()},
lab AS (SELECT *, {label_expr(level)} AS label, {profile_sql('original_sentence', profile)} AS t FROM sent),
tr AS (SELECT doc_id, line_no, label, t FROM lab WHERE {train_where}),
ap AS (SELECT doc_id, line_no, split, label, t FROM lab WHERE {apply_where}),
ntr AS (SELECT count(*) AS n FROM tr),
{",".join(blocks)}{sub_sql},
xtr AS (SELECT x.*, tr.label FROM ({" UNION ALL ".join(xtr)}) x JOIN tr USING (doc_id, line_no)),
xap AS ({" UNION ALL ".join(xap)}),
{nb_ctes("SELECT * FROM xtr", "SELECT doc_id, line_no, label FROM tr", "SELECT * FROM xap",
         "SELECT doc_id, line_no FROM ap", " + ".join(nf))},
gp AS (SELECT ap.split, ap.label AS gold, pred.pred FROM ap JOIN pred USING (doc_id, line_no)),
"""


def eval_levels_sql(level: str = "city", word: bool = True, char: bool = True,
                    profile: str = "agg", **kw) -> str:
    """Whole fit + evaluate: TF-IDF blocks, NB, predictions, metrics."""
    return (model_sql(level, word, char, profile, **kw)
            + levels_ctes("SELECT * FROM gp", level, "split").strip() + "\nSELECT * FROM metrics")
