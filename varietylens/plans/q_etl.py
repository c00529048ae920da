"""Fixture queries of the corpus ETL: equi-joins (speaker metadata,
anti-join, split by id list, lookup with default), catalogue, segments,
de-duplication, readers and sinks (round trips through the checkpoint
folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.clean import dedupe_keep_first, stack_columns_distinct
from ..operators.joins import anti_join, lookup_with_default
from ..operators.split import split_by_ids
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..sources.tables import table
from . import oracle_sql as O
from . import corpus, q_model, q_text
from .registry import register

SENT = f"WITH {O.lines_ctes()}"
SPLIT = f"WITH {O.corpus_ctes()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- joins ----------------------------------------------------------------------
# Speaker metadata stand-in: one row per file (conversation) with an A and a
# B label, from the documents/labels rows of the same id; files without a
# metadata row are dropped (and counted).
SIDE_SQL = """
side AS (
  SELECT d.doc_id AS conv_id, d.lang AS a_label, d.source AS b_label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
side_long AS (
  SELECT conv_id, 'A' AS speaker, a_label AS label FROM side
  UNION ALL SELECT conv_id, 'B', b_label FROM side)"""


def speaker_side(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    side = (d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
             .select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("a_label"),
                     F.col("source").alias("b_label")))
    # first match wins per file id, then A/B columns -> (file, speaker, label)
    side = side.groupBy("conv_id").agg(F.min_by(F.struct("a_label", "b_label"), "a_label").alias("s"))
    return side.select("conv_id", F.col("s.a_label").alias("A"), F.col("s.b_label").alias("B")) \
               .unpivot("conv_id", ["A", "B"], "speaker", "label")


@register("speaker_labels", f"""
WITH {q_text.TRANSCRIPT_SQL}, {SIDE_SQL},
mk AS (SELECT *, CASE WHEN text LIKE '%A:%' THEN 'A' WHEN text LIKE '%B:%' THEN 'B' END AS m FROM tr),
sp AS (SELECT conv_id, line_no,
       coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'A') AS speaker FROM mk)
SELECT sp.conv_id, sp.line_no, sp.speaker, s.label
FROM sp JOIN (SELECT DISTINCT * FROM side_long) s ON s.conv_id = sp.conv_id AND s.speaker = sp.speaker""")
def q_speaker_labels(spark, sf_dir):
    """Transcript lines labelled by their speaker's metadata (inner join on
    (file, speaker); a file without metadata is dropped)."""
    lines = W.speaker_carry(q_text.transcript_lines(spark, sf_dir), "conv_id", "line_no", "text",
                            block=8 * q_text.TURN_SHIFT)
    return lines.join(speaker_side(spark, sf_dir), ["conv_id", "speaker"]).select(
        "conv_id", "line_no", "speaker", "label")


@register("reject_counts", f"""
WITH {SIDE_SQL},
files AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CAST(count(*) AS BIGINT) AS n_files,
       CAST(count(*) FILTER (WHERE conv_id NOT IN (SELECT conv_id FROM side)) AS BIGINT) AS n_rejected
FROM files""")
def q_reject_counts(spark, sf_dir):
    """Files rejected for lack of metadata, counted with count_if."""
    files = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    have = speaker_side(spark, sf_dir).select("conv_id").distinct().withColumn("_hit", F.lit(True))
    j = files.join(have, "conv_id", "left")
    return j.agg(F.count(F.lit(1)).cast("long").alias("n_files"),
                 F.count_if(F.col("_hit").isNull()).cast("long").alias("n_rejected"))


@register("unlabelled_docs", """
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_unlabelled_docs(spark, sf_dir):
    """Left anti join: documents whose id is not in the annotated list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return anti_join(d, table(spark, sf_dir, "labels"), "doc_id")


@register("split_by_ids", """
WITH lst AS (SELECT doc_id, min(CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'test' END) AS split
             FROM labels GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.split, 'unassigned') AS split FROM documents d JOIN lst l USING (doc_id)""")
def q_split_by_ids(spark, sf_dir):
    """Split from an external id list (quality 1 -> train, 0 -> test,
    listed with NULL -> unassigned, unlisted dropped)."""
    ids = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "test").alias("split"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    return split_by_ids(d, ids, "doc_id")


@register("lookup_with_default", """
WITH lk AS (SELECT doc_id, min(CAST(toxic AS VARCHAR)) AS toxic FROM labels GROUP BY doc_id)
SELECT d.doc_id, coalesce(lk.toxic, '') AS toxic FROM documents d LEFT JOIN lk USING (doc_id)""")
def q_lookup_with_default(spark, sf_dir):
    side = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    return lookup_with_default(d, side, "doc_id", "toxic", "")


# -- aggregates -------------------------------------------------------------------
@register("dedupe_text", """
SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text""")
def q_dedupe_text(spark, sf_dir):
    """Keep the first document of every distinct text (copies of one text
    combine map-side; no window over a hot text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return dedupe_keep_first(d, "text", "doc_id").select("doc_id")


@register("lexicon", """
SELECT DISTINCT lang, w AS word FROM (
  SELECT lang, unnest(string_split(l, ' ')) AS w FROM (
    SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE w <> ''""")
def q_lexicon(spark, sf_dir):
    """Distinct words per language over every line of every document."""
    d = table(spark, sf_dir, "documents").select("lang", "text")
    lines = d.select("lang", F.explode(F.split("text", "\n", -1)).alias("l"))
    return (lines.select("lang", F.explode(F.split("l", " ", -1)).alias("word"))
                 .where(F.col("word") != "").distinct())


@register("catalog", f"""{SENT}
SELECT dialect_city_id AS dataset_name, dialect_region_id AS part, count(*) AS n_sentences,
       'lines' AS method, 'documents' AS source, 'corpus' AS kind, 'none' AS split_kind,
       array_to_string(list_sort(list_distinct(list(coalesce(dialect_province_id, 'nan')))), ',') AS list_dialect_province_id,
       array_to_string(list_sort(list_distinct(list(dialect_country_id))), ',') AS list_dialect_country_id,
       array_to_string(list_sort(list_distinct(list(dialect_region_id))), ',') AS list_dialect_region_id
FROM sent GROUP BY dialect_city_id, dialect_region_id""")
def q_catalog(spark, sf_dir):
    """Dataset catalogue (one row per dataset and region) with how and from
    what it was made and the sorted distinct label lists; each region is an
    append of its own to one catalogue folder, which is read back."""
    s = corpus.all_lines(spark, sf_dir)

    def values(c):
        return F.array_join(F.sort_array(F.collect_set(c)), ",")
    cat = (s.groupBy(F.col("dialect_city_id").alias("dataset_name"), F.col("dialect_region_id").alias("part"))
            .agg(F.count(F.lit(1)).alias("n_sentences"), F.lit("lines").alias("method"),
                 F.lit("documents").alias("source"), F.lit("corpus").alias("kind"), F.lit("none").alias("split_kind"),
                 values(F.coalesce("dialect_province_id", F.lit("nan"))).alias("list_dialect_province_id"),
                 values("dialect_country_id").alias("list_dialect_country_id"),
                 values("dialect_region_id").alias("list_dialect_region_id")))
    path = scratch(spark, "catalog")
    for region in ("germanic", "romance"):
        sinks.append_catalog(cat.where(F.col("part") == region), path)
    return spark.read.parquet(path)


@register("doc_segments", f"""{SENT}
SELECT doc_id, count(*) AS n_segments, string_agg(original_sentence, chr(10) ORDER BY line_no) AS text
FROM sent GROUP BY doc_id""")
def q_doc_segments(spark, sf_dir):
    """Ordered segments per document (one document's lines, bounded)."""
    s = corpus.all_lines(spark, sf_dir)
    return (s.groupBy("doc_id")
             .agg(F.count(F.lit(1)).alias("n_segments"),
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "original_sentence"))),
                                           lambda x: x["original_sentence"]), "\n").alias("text")))


@register("stack_columns_distinct", """
WITH t AS (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS a,
                  regexp_extract(html, '<h1>(.*?)</h1>', 1) AS b FROM pages)
SELECT DISTINCT original_sentence FROM (SELECT a AS original_sentence FROM t UNION ALL SELECT b FROM t)
WHERE original_sentence IS NOT NULL""")
def q_stack_columns_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("a"),
        F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("b"))
    return stack_columns_distinct(p, ["a", "b"])


@register("parallel_unpivot", """
SELECT conv_id, 'turn_' || turn AS variety, text AS original_sentence FROM conversations
WHERE turn IS NOT NULL AND text IS NOT NULL""")
def q_parallel_unpivot(spark, sf_dir):
    """Parallel corpus wide -> long: a conversation's turns as one wide row (a
    map from variety to text, so no variety is known to the driver), then one
    labelled row per (conversation, variety)."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn").isNotNull())
    one = c.groupBy("conv_id", "turn").agg(F.first("text").alias("text"))
    wide = one.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("variety"), "text"))).alias("row"))
    long = wide.select("conv_id", F.explode("row").alias("variety", "original_sentence"))
    return long.where(F.col("original_sentence").isNotNull())


# -- sources --------------------------------------------------------------------------
@register("json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_field(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("label_from_path", """
SELECT page_id,
       split_part(regexp_extract(url, '^https?://([^/]+)/', 1), '.', 1) AS host_label,
       regexp_extract(url, '^https?://[^/]+/([a-z][a-z])/', 1) AS lang
FROM pages""")
def q_label_from_path(spark, sf_dir):
    """Labels parsed from a path: first host label and language segment."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    return p.select("page_id", F.split_part(host, F.lit("."), F.lit(1)).alias("host_label"),
                    F.regexp_extract("url", r"^https?://[^/]+/([a-z][a-z])/", 1).alias("lang"))


@register("html_paragraphs", """
SELECT page_id, p.para_no, p.text, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM (
  SELECT page_id, html,
         unnest(regexp_extract_all(html, '<p>(.*?)</p>', 1)) AS text,
         generate_subscripts(regexp_extract_all(html, '<p>(.*?)</p>', 1), 1) - 1 AS para_no
  FROM pages) p""")
def q_html_paragraphs(spark, sf_dir):
    """Tagged-segment extraction: every <p>..</p> and the <title>."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
                    F.posexplode(F.regexp_extract_all("html", F.lit("<p>(.*?)</p>"), 1)).alias("para_no", "text"))


@register("xml_records", """
SELECT d.doc_id, d.lang, CAST(l.toxic AS INTEGER) AS toxic
FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL""")
def q_xml_records(spark, sf_dir):
    """XML record parse: documents serialised as <doc> elements with an
    optional <toxic> child, parsed back; rows without the child skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(l, "doc_id", "left")
    xml = F.concat(F.lit("<doc><id>"), F.col("doc_id").cast("string"), F.lit("</id><lang>"), F.col("lang"),
                   F.lit("</lang>"),
                   F.when(F.col("toxic").isNotNull(),
                          F.concat(F.lit("<toxic>"), F.col("toxic").cast("string"), F.lit("</toxic>")))
                    .otherwise(F.lit("")), F.lit("</doc>"))
    parsed = j.select(F.from_xml(xml, "id LONG, lang STRING, toxic INT").alias("r")).select("r.*")
    return (parsed.where(F.col("toxic").isNotNull())
                  .select(F.col("id").alias("doc_id"), "lang", "toxic"))


@register("write_read_tsv", f"""{SENT}
SELECT doc_id, line_no, original_sentence, dialect_city_id, dialect_country_id, dialect_region_id
FROM sent""")
def q_write_read_tsv(spark, sf_dir):
    """TSV sink with header, then the delimited scan with an explicit
    schema reads it back (round trip)."""
    s = corpus.all_lines(spark, sf_dir).select(
        "doc_id", "line_no", "original_sentence", "dialect_city_id", "dialect_country_id",
        "dialect_region_id")
    path = scratch(spark, "tsv")
    sinks.write_tsv(s, path)
    schema = ("doc_id LONG, line_no INT, original_sentence STRING, dialect_city_id STRING, "
              "dialect_country_id STRING, dialect_region_id STRING")
    return readers.read_delimited(spark, path, schema)


@register("train_union", f"""{SPLIT}
SELECT {O.label_expr('city')} AS label, count(*) AS n_sentences FROM sent WHERE split = 'train' GROUP BY ALL""")
def q_train_union(spark, sf_dir):
    """Training-set scan: one TSV per region with columns in different
    orders, unioned by column name."""
    s = q_model.sentences(spark, sf_dir).where("split = 'train'")
    base = scratch(spark, "train")
    cols = ["original_sentence", "dialect_city_id", "dialect_country_id", "dialect_region_id"]
    paths = []
    for i, reg in enumerate(["germanic", "romance"]):
        order = cols if i == 0 else list(reversed(cols))
        p = f"{base}/{reg}"
        sinks.write_tsv(s.where(F.col("dialect_region_id") == reg).select(*order), p)
        paths.append(p)
    schema0 = ", ".join(f"{c} STRING" for c in cols)
    frames = [readers.read_delimited(spark, paths[0], schema0),
              readers.read_delimited(spark, paths[1], ", ".join(f"{c} STRING" for c in reversed(cols)))]
    u = readers.union_by_name(frames)
    from ..functions.labels import compose_label
    return u.groupBy(compose_label("city").alias("label")).agg(F.count(F.lit(1)).alias("n_sentences"))


@register("partitioned_corpus", f"""{SPLIT},
lab AS (SELECT {O.label_expr('city')} AS label, original_sentence FROM sent WHERE split = 'train')
SELECT unit, label, t AS line, count(*) AS n FROM (
  SELECT 'word' AS unit, label, original_sentence AS t FROM lab
  UNION ALL SELECT 'char', label, array_to_string(string_split(replace(original_sentence, ' ', 'X'), ''), ' ')
  FROM lab) GROUP BY ALL""")
def q_partitioned_corpus(spark, sf_dir):
    """One text folder per (unit, label), word and char streams of the
    training sentences, read back with partition discovery: each line and how
    often it is there."""
    from ..functions.text import char_stream
    s = q_model.sentences(spark, sf_dir).where("split = 'train'")
    streams = F.create_map(F.lit("word"), F.col("original_sentence"), F.lit("char"), char_stream("original_sentence"))
    path = scratch(spark, "lmcorpus")
    sinks.write_partitioned_corpus(s.select("label", F.explode(streams).alias("unit", "t")), path, ["unit", "label"], "t")
    back = spark.read.option("basePath", path).option("lineSep", "\n").text(path)
    return (back.groupBy(F.col("unit").cast("string").alias("unit"), F.col("label").cast("string").alias("label"),
                         F.col("value").alias("line"))
                .agg(F.count(F.lit(1)).alias("n")))


@register("folder_union", """
SELECT source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source""")
def q_folder_union(spark, sf_dir):
    """Folder scan: one Parquet folder per source, read as one scan."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    path = scratch(spark, "folder")
    d.write.partitionBy("source").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                                      F.sum("n_chars").cast("long").alias("n_chars"))


@register("ordered_lines", f"""{SENT}
SELECT doc_id, line_no, original_sentence AS text FROM sent""")
def q_ordered_lines(spark, sf_dir):
    """Whole-file ordered line scan over text files written per source, each
    document under a header line: blank lines dropped, line numbers kept. The
    header carried down gives every line's document and place in it."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    path = scratch(spark, "text")
    docs.select("source", F.concat(F.lit("#doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value")) \
        .write.partitionBy("source").text(path)
    lines = readers.read_ordered_lines(spark, path)
    doc = F.nullif(F.regexp_extract("text", "^#doc ([0-9]+)$", 1), F.lit(""))
    head = F.when(doc.isNotNull(), F.concat(doc, F.lit(":"), F.col("line_no").cast("string")))
    out = W.carry_forward(lines, ["file"], "line_no", head, "head")

    def part(i):
        return F.split_part("head", F.lit(":"), F.lit(i)).cast("long")
    return (out.where(doc.isNull() & (F.trim("text") != ""))
               .select(part(1).alias("doc_id"), (F.col("line_no") - part(2) - 1).alias("line_no"), "text"))


@register("canonical_projection", """
SELECT c_name AS original_sentence, 'x_city' AS dialect_city_id, c_mktsegment AS dialect_province_id,
       CAST(c_nationkey AS VARCHAR) AS dialect_country_id, 'x_region' AS dialect_region_id, c_acctbal AS balance
FROM customer""")
def q_canonical_projection(spark, sf_dir):
    """Positional projection: ints pick columns by position, strings are
    constants, extras by position."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    return readers.canonical_projection(c, 1, "x_city", 4, 2, "x_region", {"balance": 3})


@register("preclean", """
SELECT conv_id, turn, CAST(text AS VARCHAR) AS text FROM conversations WHERE text IS NOT NULL""")
def q_preclean(spark, sf_dir):
    from ..operators.clean import preclean
    return preclean(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["text"])


# -- remaining projection / routing / patch operators ------------------------------
@register("cell_patch", """
WITH patch AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END AS c_mktsegment FROM customer
               WHERE c_acctbal < 0)
SELECT c.c_custkey, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment, c.c_nationkey
FROM customer c LEFT JOIN patch p USING (c_custkey)""")
def q_cell_patch(spark, sf_dir):
    """Dirty metadata fixed by a patch table keyed by id (left join +
    coalesce of the patched cells)."""
    from ..operators.corrections import cell_patch
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    patch = c.where(F.col("c_acctbal") < 0).select("c_custkey", F.lit("NEGATIVE").alias("c_mktsegment"))
    return cell_patch(c.drop("c_acctbal"), patch, "c_custkey")


@register("exclude_labels", f"""{SENT}
SELECT doc_id, line_no, {O.label_expr('city')} AS label FROM sent
WHERE dialect_city_id NOT IN ('src0', 'src1') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_exclude_labels(spark, sf_dir):
    """Labels excluded from a layer (literal list) and a list of excluded
    files (anti join on the id list)."""
    from ..functions.labels import compose_label
    from ..operators.clean import exclude_values
    s = corpus.all_lines(spark, sf_dir)
    s = exclude_values(s, "dialect_city_id", ["src0", "src1"])
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return anti_join(s, bad, "doc_id").select("doc_id", "line_no", compose_label("city").alias("label"))


@register("route_rows", f"""{SENT}
SELECT CASE WHEN dialect_country_id IN ('en', 'de') THEN 'north' ELSE 'south' END AS route,
       doc_id, line_no, dialect_region_id, original_sentence
FROM sent""")
def q_route_rows(spark, sf_dir):
    """Rows routed by a field value to two labelled outputs (one folder per
    route), read back."""
    routed = corpus.all_lines(spark, sf_dir).withColumn(
        "route", F.when(F.col("dialect_country_id").isin("en", "de"), "north").otherwise("south"))
    path = scratch(spark, "routes")
    routed.select("route", "doc_id", "line_no", "dialect_region_id", "original_sentence") \
          .write.partitionBy("route").parquet(path)
    return spark.read.parquet(path).withColumn("route", F.col("route").cast("string"))


@register("id_line_clean", """
SELECT page_id,
       regexp_replace(regexp_replace(url, '^[^/]*/', ''), '\\n$', '') AS rest,
       replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '-', '_') AS host_key,
       substr(split_part(regexp_replace(url, '^https?://', ''), '/', 1), 3,
              greatest(length(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) - 6, 0)) AS audit
FROM pages""")
def q_id_line_clean(spark, sf_dir):
    """Id-line normalisation: prefix up to the first '/' and a trailing
    newline removed; '-' -> '_'; slice [2:-4] of a code."""
    p = table(spark, sf_dir, "pages")
    host = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace("url", "^[^/]*/", ""), "\\n$", "")
    audit = F.substring(host, 3, F.greatest(F.length(host) - 6, F.lit(0)))
    return p.select("page_id", rest.alias("rest"), F.replace(host, F.lit("-"), F.lit("_")).alias("host_key"),
                    audit.alias("audit"))


@register("predictions_sink", q_model._model_sql("""
SELECT ap.label AS gold, pred.pred FROM ap JOIN pred USING (doc_id, line_no)"""))
def q_predictions_sink(spark, sf_dir):
    """Evaluation predictions written as a ``gold, pred`` TSV and read back."""
    fm = q_model.fitted(spark, sf_dir, q_model.FULL)
    from . import model
    s = q_model.sentences(spark, sf_dir).where("split <> 'train'")
    gp = s.select(*q_model.KEYS, F.col("label").alias("gold")).join(model.predict(fm, s, q_model.KEYS),
                                                                    q_model.KEYS)
    path = scratch(spark, "pred")
    sinks.write_predictions(gp, path)
    return readers.read_delimited(spark, path, "gold STRING, pred STRING")


@register("scan_delimited", """
SELECT c_custkey, c_name, c_acctbal FROM customer""")
def q_scan_delimited(spark, sf_dir):
    """Delimited scan with an explicit schema: a TSV folder holding the good
    rows and malformed lines (wrong field count / type) reads back as the
    good rows only (DROPMALFORMED)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch(spark, "delim")
    c.write.option("sep", "\t").csv(path + "/good")
    bad = c.select(F.concat_ws("\t", F.col("c_name"), F.lit("not-a-number"), F.lit("x")).alias("value"))
    bad.unionByName(c.select(F.col("c_name").alias("value"))).write.text(path + "/bad")
    return readers.read_delimited(spark, path + "/*", "c_custkey LONG, c_name STRING, c_acctbal DOUBLE",
                                  header=False)
