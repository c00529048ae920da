"""Fixture queries of the readers on files that Spark wrote, of lookups that
record their misses and of packed score lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.joins import lookup_recorded
from ..sources import readers
from ..sources.tables import table
from . import oracle_sql as O
from .q_etl import scratch
from .registry import register

SENT = f"WITH {O.lines_ctes()}"
# Numbered files and the label of each range of numbers.
RANGES = [(1, 11, "short_post"), (11, 19, "speech"), (19, 53, "message"), (53, 72, "blog"), (72, 84, "picture"), (84, 89, "forum")]
FILES = 97  # so some numbers lie in no range


@register("ordered_lines_charset", f"""{SENT}
SELECT doc_id, line_no, t AS text, CAST(strlen(original_sentence) - strlen(t) AS BIGINT) AS dropped
FROM (SELECT *, regexp_replace(original_sentence, '[^\\x00-\\x7F]', '', 'g') AS t FROM sent) WHERE trim(t) <> ''""")
def q_ordered_lines_charset(spark, sf_dir):
    """Text files read as ASCII, undecodable bytes left out and counted; files
    may be split among tasks, and every line keeps its number in its file. The
    header line above each document gives the line's document and place."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    path = scratch(spark, "charset")
    docs.select("source", F.concat(F.lit("#doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value")) \
        .write.partitionBy("source").text(path)
    lines = readers.read_ordered_lines_split(spark, path, charset="ascii")
    doc = F.nullif(F.regexp_extract("text", "^#doc ([0-9]+)$", 1), F.lit(""))
    head = F.when(doc.isNotNull(), F.concat(doc, F.lit(":"), F.col("line_no").cast("string")))
    out = W.carry_forward(lines, ["file"], "line_no", head, "head")

    def part(i):
        return F.split_part("head", F.lit(":"), F.lit(i)).cast("long")
    return (out.where(doc.isNull() & (F.trim("text") != ""))
               .select(part(1).alias("doc_id"), (F.col("line_no") - part(2) - 1).alias("line_no"), "text", "dropped"))


@register("label_ranges", "WITH r(first, stop, kind) AS (VALUES " + ", ".join(map(str, RANGES)) + f""")
SELECT d.doc_id, CAST(d.doc_id % {FILES} + 1 AS BIGINT) AS file_no, coalesce(r.kind, '') AS kind
FROM documents d LEFT JOIN r ON d.doc_id % {FILES} + 1 >= r.first AND d.doc_id % {FILES} + 1 < r.stop""")
def q_label_ranges(spark, sf_dir):
    """Labels by the number in a file's name and a table of number ranges: a
    folder per number is written, and the number is read off the path."""
    path = scratch(spark, "numbered")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % FILES + 1).alias("n"))
    docs.write.partitionBy("n").csv(path)
    back = spark.read.schema("doc_id long").option("recursiveFileLookup", True).csv(path)
    back = back.select("doc_id", readers.number_in_name(F.col("_metadata.file_path")).alias("file_no"))
    ranges = spark.createDataFrame(RANGES, "first long, end long, kind string")
    return readers.label_by_range(back, "file_no", ranges)


@register("lookup_misses", """
SELECT d.doc_id, '' AS toxic, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL)) AS BIGINT) AS n_missed
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL)""")
def q_lookup_misses(spark, sf_dir):
    """Side outputs of a lookup in one pass: the rows without a label, read
    from their own folder, and both counts, taken while it was written."""
    side = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    _, missed, counts = lookup_recorded(docs, side, "doc_id", "toxic", scratch(spark, "lookup"))
    return missed.select("doc_id", "toxic", F.lit(counts["rows"]).cast("long").alias("n_rows"),
                         F.lit(counts["missed"]).cast("long").alias("n_missed"))


@register("lines_from_files", """
SELECT lang, l AS text, count(*) AS n FROM (
  SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL""")
def q_lines_from_files(spark, sf_dir):
    """Line scan of text files, one sentence per line, label from the folder;
    each line and how often it is there."""
    path = scratch(spark, "lines")
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    docs.select(F.col("lang"), F.col("text").alias("value")).write.partitionBy("lang").text(path)
    lines = None
    for lang in sorted(r["lang"] for r in docs.select("lang").distinct().collect()):  # a folder per label
        part = readers.read_lines(spark, f"{path}/lang={lang}", "\n").select(F.lit(lang).alias("lang"), "text")
        lines = part if lines is None else lines.unionByName(part)
    return lines.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n"))


@register("xml_from_files", """
SELECT d.doc_id, d.lang, CAST(l.toxic AS INTEGER) AS toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL""")
def q_xml_from_files(spark, sf_dir):
    """XML records of files: documents written as <doc> elements with an
    optional <toxic> child, read back; records without the child skipped."""
    path = scratch(spark, "xml")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id", "left")
    docs.write.format("xml").option("rowTag", "doc").option("rootTag", "docs").save(path)
    return readers.read_xml_records(spark, path, "doc", "doc_id long, lang string, toxic int").where("toxic is not null")


@register("json_from_files", """
SELECT t AS text, count(*) AS n FROM (
  SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def q_json_from_files(spark, sf_dir):
    """One field of JSON-lines files, white space collapsed; each value and
    how often it is there."""
    path = scratch(spark, "json")
    table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").write.json(path)
    return readers.read_json_field(spark, path, "text").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@register("packed_scores", """
WITH p AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS v,
                  list_transform(generate_series(1, 16), lambda i: (i + vec_id) % 5 = 0) AS nil FROM embeddings),
q AS (SELECT vec_id, list_transform(generate_series(1, 16), lambda i: CASE WHEN nil[i] THEN 0 ELSE v[i] END) AS s FROM p)
SELECT vec_id, 'city_' || list_position(s, list_max(s)) AS best, CAST(list_max(s) AS DOUBLE) AS score FROM q""")
def q_packed_scores(spark, sf_dir):
    """Packed score lists as text (``<NIL>``: no score, counts as 0) with their
    names in a column header: the name of the highest score, the first on
    ties."""
    from ..functions.text import packed_best
    e = table(spark, sf_dir, "embeddings")
    said = F.transform(F.slice("embedding", 1, 16), lambda x, i: F.when((i + 1 + F.col("vec_id")) % 5 == 0, F.lit("<NIL>")).otherwise(
        F.round(x.cast("double") * 1000000).cast("long").cast("string")))
    header = "#4 Features " + ",".join(f"city_{i}" for i in range(1, 17))
    best = packed_best(F.array_join(said, ","), header, "#4 Features ")
    return e.select("vec_id", best["name"].alias("best"), best["score"].alias("score"))
