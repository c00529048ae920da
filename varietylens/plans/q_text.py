"""Fixture queries of the cleaning, scalar-function and ordered-line
operators (transcripts, SGML-ish streams, packed records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..operators.clean import line_start_filter, sentinel_null, skip_preamble
from ..sources.tables import table
from . import oracle_sql as O
from . import corpus
from .registry import register

SENT = f"WITH {O.lines_ctes()}"


def _sent(spark, sf_dir) -> DataFrame:
    return corpus.all_lines(spark, sf_dir).select("doc_id", "line_no", "original_sentence")


# -- scalar text functions over every corpus line -----------------------------
@register("word_tokens", f"""{SENT}
SELECT doc_id, line_no, {O.profile_sql('original_sentence', 'tok')} AS tokens FROM sent""")
def q_word_tokens(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", "line_no", T.word_tokens("original_sentence").alias("tokens"))


@register("char_stream", f"""{SENT}
SELECT doc_id, line_no, array_to_string(string_split(replace(original_sentence, ' ', 'X'), ''), ' ') AS chars
FROM sent""")
def q_char_stream(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", "line_no", T.char_stream("original_sentence").alias("chars"))


ACCENTED, PLAIN = "éèêëàâçôûüîïäöß", "eeeeaacouuiiaos"


@register("strip_marks", f"""{SENT}
SELECT doc_id, line_no,
       translate(regexp_replace(original_sentence, '{T.ARABIC_MARKS}', '', 'g'), '{ACCENTED}', '{PLAIN}') AS text
FROM sent""")
def q_strip_marks(spark, sf_dir):
    """Mark removal (Arabic mark class: a no-op on this corpus) and accent
    folding by a one-to-one character map."""
    return _sent(spark, sf_dir).select(
        "doc_id", "line_no",
        T.transliterate(T.strip_marks("original_sentence"), ACCENTED, PLAIN).alias("text"))


@register("transliterate", f"""{SENT}
SELECT doc_id, line_no, translate(original_sentence, 'aeiou', 'AEIOU') AS text FROM sent""")
def q_transliterate(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", "line_no",
                                       T.transliterate("original_sentence", "aeiou", "AEIOU").alias("text"))


@register("repeat_sentence", f"""{SENT}
SELECT doc_id, line_no, trim(repeat(original_sentence || ' ', 2)) AS text FROM sent""")
def q_repeat_sentence(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", "line_no",
                                       T.repeat_sentence("original_sentence", 1).alias("text"))


@register("script_token_filter", f"""{SENT}
SELECT doc_id, line_no,
       array_to_string(list_filter(regexp_split_to_array(original_sentence, '\\s+'),
                                   lambda t: regexp_full_match(t, '[a-z]+')), ' ') AS text
FROM sent""")
def q_script_token_filter(spark, sf_dir):
    """Keep tokens written only in the target script (here lower-case
    Latin; the Arabic letter block is the default)."""
    return _sent(spark, sf_dir).select(
        "doc_id", "line_no", T.script_token_filter("original_sentence", "a-z").alias("text"))


@register("noise_removal", f"""{SENT}
SELECT doc_id, line_no,
       regexp_replace(replace(replace(original_sentence, 'the', ''), 'le', ''), '[()]', '', 'g') AS text
FROM sent""")
def q_noise_removal(spark, sf_dir):
    return _sent(spark, sf_dir).select(
        "doc_id", "line_no", T.noise_removal("original_sentence", ["the", "le"]).alias("text"))


@register("line_start_filter", f"""{SENT}
SELECT doc_id, line_no, original_sentence FROM sent
WHERE original_sentence <> '' AND NOT regexp_matches(original_sentence, '^[(A-Za-z]')""")
def q_line_start_filter(spark, sf_dir):
    return line_start_filter(_sent(spark, sf_dir), "original_sentence")


@register("whitespace_norm", """
SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS text FROM pages""")
def q_whitespace_norm(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.whitespace_norm("html").alias("text"))


@register("attr_extract", f"""{SENT},
tags AS (SELECT doc_id, line_no, '<seg id="' || doc_id || '_' || line_no || '_x_">' AS tag FROM sent),
ids AS (SELECT doc_id, line_no,
               regexp_replace(regexp_replace(regexp_extract(tag, 'id="([^"]*)"', 1), '[^0-9_]', '', 'g'),
                              '_+$', '') AS v FROM tags)
SELECT doc_id, line_no, lpad(v, CAST(greatest(length(v), 3) AS INTEGER), '0') AS seg_id FROM ids""")
def q_attr_extract(spark, sf_dir):
    """Quoted attribute from a tag line, digits/underscores kept, trailing
    underscores dropped, left-padded to 3 without truncation."""
    s = _sent(spark, sf_dir)
    tag = F.concat(F.lit('<seg id="'), F.col("doc_id").cast("string"), F.lit("_"),
                   F.col("line_no").cast("string"), F.lit('_x_">'))
    return s.select("doc_id", "line_no", T.padded_seg_id(T.attr_value(tag, "id")).alias("seg_id"))


@register("sentinel_null", """
SELECT event_id, CASE WHEN event_type IN ('error', '(na)') THEN NULL ELSE event_type END AS event_type
FROM events""")
def q_sentinel_null(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", sentinel_null("event_type", ["error", "(na)"]).alias("event_type"))


# -- ordered-line operators over transcripts ---------------------------------
# Transcript stand-in: each conversation is a file; its lines are the lines
# of its turns in order; the first line of a turn carries the speaker
# marker (A: for the user, B: otherwise). Order key = turn * 2^20 + line.
TURN_SHIFT = 1 << 20

TRANSCRIPT_SQL = f"""
tl AS (
  SELECT conv_id, turn, role, unnest(string_split(text, {O.NL})) AS line,
         generate_subscripts(string_split(text, {O.NL}), 1) - 1 AS pos
  FROM conversations),
tr AS (
  SELECT conv_id, turn * {TURN_SHIFT} + pos AS line_no,
         CASE WHEN pos = 0 THEN (CASE WHEN role = 'user' THEN 'A: ' ELSE 'B: ' END) ELSE '' END || line AS text
  FROM tl)"""


def transcript_lines(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tl = c.select("conv_id", "turn", "role",
                  F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    marker = F.when(F.col("role") == "user", F.lit("A:")).otherwise(F.lit("B:"))
    order = F.col("turn") * TURN_SHIFT + F.col("pos")
    if strict:
        # a bare marker line before each turn (order slot pos = -1 -> shifted)
        body = tl.select("conv_id", (order * 2 + 2).alias("line_no"), F.col("line").alias("text"))
        marks = (tl.where("pos = 0")
                   .select("conv_id", (F.col("turn") * TURN_SHIFT * 2).alias("line_no"), marker.alias("text")))
        return body.unionByName(marks)
    text = F.when(F.col("pos") == 0, F.concat(marker, F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    return tl.select("conv_id", order.alias("line_no"), text.alias("text"))


@register("speaker_carry", f"""
WITH {TRANSCRIPT_SQL},
mk AS (SELECT *, CASE WHEN text LIKE '%A:%' THEN 'A' WHEN text LIKE '%B:%' THEN 'B' END AS m FROM tr)
SELECT conv_id, line_no,
       coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'A') AS speaker,
       CASE WHEN text LIKE '%A:%' THEN replace(text, 'A:', '')
            WHEN text LIKE '%B:%' THEN replace(text, 'B:', '') ELSE text END AS text
FROM mk""")
def q_speaker_carry(spark, sf_dir):
    """Speaker recovered by carrying the last marker forward (two-level
    block scan: a huge transcript is not one task)."""
    lines = transcript_lines(spark, sf_dir)
    return W.speaker_carry(lines, "conv_id", "line_no", "text",
                           block=8 * TURN_SHIFT).select("conv_id", "line_no", "speaker", "text")


@register("speaker_carry_strict", f"""
WITH {TRANSCRIPT_SQL},
tr2 AS (
  SELECT conv_id, line_no * 2 + 2 AS line_no, substr(text, 4) AS text FROM tr
  WHERE line_no % {TURN_SHIFT} = 0
  UNION ALL SELECT conv_id, line_no * 2 + 2, text FROM tr WHERE line_no % {TURN_SHIFT} <> 0
  UNION ALL SELECT conv_id, line_no * 2, substr(text, 1, 2) FROM tr WHERE line_no % {TURN_SHIFT} = 0),
mk AS (SELECT *, CASE WHEN trim(text) = 'A:' THEN 'A' WHEN trim(text) = 'B:' THEN 'B' END AS m FROM tr2)
SELECT conv_id, line_no, speaker, text FROM (
  SELECT conv_id, line_no, m, text,
         coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'A') AS speaker
  FROM mk) WHERE m IS NULL""")
def q_speaker_carry_strict(spark, sf_dir):
    """Strict variant: only a line equal to ``A:``/``B:`` switches; the
    marker lines themselves are not emitted."""
    lines = transcript_lines(spark, sf_dir, strict=True)
    out = W.carry_forward(lines, ["conv_id"], "line_no",
                          W.speaker_marker(F.col("text"), strict=True), "speaker",
                          block=16 * TURN_SHIFT, default="A")
    return (out.where(W.speaker_marker(F.col("text"), strict=True).isNull())
               .select("conv_id", "line_no", "speaker", "text"))


@register("lead_marker", f"""
WITH {TRANSCRIPT_SQL},
nx AS (SELECT conv_id, line_no, text,
              lead(text) OVER (PARTITION BY conv_id ORDER BY line_no) AS next_text FROM tr)
SELECT conv_id, line_no, next_text FROM nx
WHERE text LIKE '%: %' AND next_text LIKE '%: %'""")
def q_lead_marker(spark, sf_dir):
    """Emit the next line when both it and the current line carry the
    marker (``: ``; consecutive single-line turns)."""
    lines = transcript_lines(spark, sf_dir)
    return W.lead_marker(lines, ["conv_id"], "line_no", "text", ": ", block=4 * TURN_SHIFT).select(
        "conv_id", "line_no", "next_text")


# SGML-ish stream: per source, every document becomes <DOC docid="..">,
# <HEADLINE>, first line, </HEADLINE>?, <P>, remaining lines, </P>.
STREAM_SQL = f"""
{O.lines_ctes()[1:]},
st AS (
  SELECT dialect_city_id AS src, doc_id * {TURN_SHIFT} * 4 + line_no * 4 + 2 AS ord, original_sentence AS text
  FROM sent
  UNION ALL SELECT source, doc_id * {TURN_SHIFT} * 4, '<DOC docid="' || doc_id || '">' FROM docs
  UNION ALL SELECT source, doc_id * {TURN_SHIFT} * 4 + 1, '<P>' FROM docs
  UNION ALL SELECT source, doc_id * {TURN_SHIFT} * 4 + {TURN_SHIFT} * 4 - 1, '</P>' FROM docs)"""


def sgml_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and non-blank lines of every document by one explode of one scan."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    base = F.col("doc_id") * (TURN_SHIFT * 4)

    def line(order, text):
        return F.struct(order.cast("long").alias("ord"), text.alias("text"))
    tags = F.array(line(base, F.concat(F.lit('<DOC docid="'), F.col("doc_id").cast("string"), F.lit('">'))),
                   line(base + 1, F.lit("<P>")), line(base + TURN_SHIFT * 4 - 1, F.lit("</P>")))
    body = F.transform(F.split("text", "\n", -1), lambda t, i: line(base + i * 4 + 2, t))
    return docs.select(F.col("source").alias("src"),
                       F.inline(F.concat(tags, F.filter(body, lambda x: F.trim(x["text"]) != ""))))


@register("carry_doc_id", f"""
WITH {STREAM_SQL},
mk AS (SELECT *, nullif(regexp_extract(text, 'docid="([^"]*)"', 1), '') AS d FROM st)
SELECT src, ord, doc, text FROM (
  SELECT src, ord, text, d,
         last_value(d IGNORE NULLS) OVER (PARTITION BY src ORDER BY ord
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc
  FROM mk) WHERE d IS NULL AND text NOT IN ('<P>', '</P>')""")
def q_carry_doc_id(spark, sf_dir):
    """Current document id carried over the lines of an SGML-ish stream."""
    st = sgml_stream(spark, sf_dir)
    d = F.nullif(T.attr_value(F.col("text"), "docid"), F.lit(""))
    out = W.carry_forward(st, ["src"], "ord", d, "doc", block=64 * TURN_SHIFT * 4)
    return (out.where(d.isNull() & ~F.col("text").isin("<P>", "</P>"))
               .select("src", "ord", "doc", "text"))


@register("islands", f"""
WITH {STREAM_SQL},
fl AS (SELECT *,
  sum(CASE WHEN text LIKE '<DOC %' THEN 1 ELSE 0 END) OVER w AS group_no,
  sum(CASE WHEN text = '<P>' THEN 1 ELSE 0 END) OVER w AS o,
  sum(CASE WHEN text = '</P>' THEN 1 ELSE 0 END) OVER w AS c
  FROM st WINDOW w AS (PARTITION BY src ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT src, group_no, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM fl WHERE o > c AND text <> '<P>' GROUP BY ALL""")
def q_islands(spark, sf_dir):
    """Lines grouped by the running count of start markers; only lines
    between <P> and </P> belong to a group."""
    st = sgml_stream(spark, sf_dir)
    t = F.col("text")
    g = W.islands(st, ["src"], "ord", t.startswith("<DOC "), t == "<P>", t == "</P>",
                  block=64 * TURN_SHIFT * 4)
    return (g.where(F.col("inside") & (t != "<P>"))
             .groupBy("src", "group_no")
             .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars")))


@register("skip_preamble", f"""
WITH {STREAM_SQL},
fm AS (SELECT src, min(ord) AS first_m FROM st WHERE text LIKE '%<P>%' GROUP BY src)
SELECT st.src, st.ord, st.text FROM st JOIN fm USING (src)
WHERE st.ord > fm.first_m AND st.text NOT LIKE '%<P>%'""")
def q_skip_preamble(spark, sf_dir):
    """Drop everything up to the first marker line of each stream, then
    every marker line (marker: ``<P>``)."""
    return skip_preamble(sgml_stream(spark, sf_dir), "src", "ord", "text", "<P>").select("src", "ord", "text")


# -- packed values --------------------------------------------------------------
@register("packed_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best,
       'dim_' || (list_position(embedding, list_max(embedding)) - 1) AS best_name
FROM embeddings""")
def q_packed_argmax(spark, sf_dir):
    """Arg-max of a packed score vector against a header of names; the
    first position wins ties."""
    e = table(spark, sf_dir, "embeddings")
    pos = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    return e.select("vec_id", pos.alias("best"),
                    F.concat(F.lit("dim_"), pos.cast("string")).alias("best_name"))


@register("packed_record", """
WITH p AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 4 = 0 THEN c_name || ':' || c_mktsegment
              ELSE c_name || ':' || c_mktsegment || ':' || c_nationkey || ':x:' || c_custkey END AS rec
  FROM customer)
SELECT c_custkey, string_split(rec, ':')[1] AS f1, string_split(rec, ':')[5] AS f5 FROM p
WHERE string_split(rec, ':')[5] IS NOT NULL""")
def q_packed_record(spark, sf_dir):
    """``:``-packed side-table records: fields 1 and 5, records without a
    5th field skipped (NULL on out-of-range access)."""
    c = table(spark, sf_dir, "customer")
    rec = F.when(F.col("c_custkey") % 4 == 0, F.concat_ws(":", "c_name", "c_mktsegment")).otherwise(
        F.concat_ws(":", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("x"),
                    F.col("c_custkey").cast("string")))
    parts = F.split(rec, ":")
    return (c.select("c_custkey", F.get(parts, 0).alias("f1"), F.get(parts, 4).alias("f5"))
             .where(F.col("f5").isNotNull()))


@register("numeric_sentinel", """
SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0.0 ELSE CAST(x AS DOUBLE) END)) > 0 AS any_pos,
       CAST(len(list_filter(embedding, lambda x: x < 0)) AS INTEGER) AS n_sentinel
FROM embeddings""")
def q_numeric_sentinel(spark, sf_dir):
    """Numeric parse with a sentinel value mapped to 0 (negatives stand in
    for ``<NIL>``)."""
    e = table(spark, sf_dir, "embeddings")
    vals = F.transform("embedding", lambda x: F.when(x < 0, F.lit(0.0)).otherwise(x.cast("double")))
    return e.select("vec_id",
                    (F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) > 0).alias("any_pos"),
                    F.size(F.filter("embedding", lambda x: x < 0)).cast("int").alias("n_sentinel"))
