"""Readers for the raw corpus layouts. All are Spark's own scans with an
explicit schema (never inferred) and file provenance from ``_metadata``."""

from __future__ import annotations

import codecs
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t",
                   header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited scan; malformed rows are dropped silently. Legacy charsets
    (ISO-8859-6, windows-1256) need ``spark.sql.legacy.javaCharsets=true``."""
    return (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
                 .option("mode", "DROPMALFORMED").schema(schema).csv(path))


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """One row per line (order not kept), with the source file name."""
    return (spark.read.text(path, lineSep=line_sep)
                 .select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file")))


def read_ordered_lines(spark: SparkSession, path: str, drop_blank: bool = True) -> DataFrame:
    """Whole files, one row per line with its 0-based line number; blank
    lines dropped. A file is read by one task (it must be, to number its
    lines); files are the unit of parallelism. ``wholetext`` is an argument:
    as an option, the argument's default would override it."""
    whole = (spark.read.text(path, wholetext=True)
                  .select(F.col("_metadata.file_path").alias("file"), F.col("value")))
    lines = whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "text"))
    return lines.where(F.col("text") != "") if drop_blank else lines


def decode_bytes(raw, charset: str):
    """Text of a binary column in ``charset``, undecodable bytes left out.

    A single-byte charset is one byte, one character: the bytes are read as
    Latin-1 and its upper half is translated; what the charset does not define
    has nothing to become and goes."""
    if codecs.lookup(charset).name == "utf-8":
        return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))
    known = {}
    for b in range(256):
        try:
            known[b] = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            known[b] = ""
    moved = {chr(b): c for b, c in known.items() if chr(b) != c}
    order = sorted(moved, key=lambda c: not moved[c])  # those that go come last
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(order), "".join(moved[c] for c in order))


def read_ordered_lines_split(spark: SparkSession, path: str, charset: str = "UTF-8", drop_blank: bool = True) -> DataFrame:
    """(file, line_no, text, dropped): one row per line with its 0-based number
    in the file, read in ``charset``; dropped: bytes that could not be decoded.

    Files are split: a task numbers the lines of its block of a file, and the
    blocks' line counts, summed up along each file (one row per block), give
    where a block begins. So one huge file is not one task. The charset must be
    one byte a character, or UTF-8."""
    raw = (spark.read.text(path, lineSep="\n")
                .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("place")))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
                 .select("file", "block", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")))
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    text = decode_bytes(F.col("raw"), charset)
    kept = F.octet_length(text) if codecs.lookup(charset).name == "utf-8" else F.char_length(text)
    out = (raw.withColumn("in_block", number).join(blocks, ["file", "block"])
              .select("file", (F.col("before") + F.col("in_block") - 1).alias("line_no"), text.alias("text"),
                      (F.octet_length("raw") - kept).cast("long").alias("dropped")))
    return out.where(F.col("text") != "") if drop_blank else out


def number_in_name(file):
    """Number that a file's name (or, for files of Spark's own writers, its
    folder's name) ends with; null if there is none."""
    stem = F.regexp_extract(file, r"([0-9]+)(?:\.[A-Za-z]+)*(?:/part-[^/]*)?$", 1)
    return F.when(stem != "", stem.cast("long"))


def label_by_range(df: DataFrame, number: str, ranges: DataFrame, default: str = "") -> DataFrame:
    """``df`` with the columns of the range that its ``number`` lies in.
    ``ranges`` has ``first``, ``end`` (first number beyond) and label columns;
    ranges do not overlap. Where none holds the number, ``default``.

    The distinct numbers and the sorted range starts are merged once and the
    latest start is carried down; df is joined by equality."""
    names = [c for c in ranges.columns if c not in ("first", "end")]
    own = df.select(F.col(number).alias("_at")).where(F.col(number).isNotNull()).distinct()
    none = F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ranges.schema.fields) + ">")
    both = own.select("_at", F.lit(1).alias("_kind"), none.alias("_range")).unionByName(
        ranges.select(F.col("first").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(*ranges.columns).alias("_range")))
    # one row per distinct number and range
    latest = F.last("_range", ignorenulls=True).over(Window.orderBy("_at", "_kind"))
    found = both.withColumn("_range", latest).where("_kind = 1 and _at < _range.end").select("_at", *[F.col(f"_range.{c}") for c in names])
    out = df.join(found, df[number] == found["_at"], "left")
    return out.select(*[df[c] for c in df.columns], *[F.coalesce(found[c], F.lit(default)).alias(c) for c in names])


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """XML scan, one row per ``row_tag`` element."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_field(spark: SparkSession, path: str, field: str, collapse_ws: bool = True) -> DataFrame:
    """One string field of JSON-lines records (whitespace collapsed)."""
    from ..functions.text import whitespace_norm
    raw = spark.read.text(path).select(F.get_json_object("value", f"$.{field}").alias(field),
                                       F.col("_metadata.file_name").alias("file"))
    return raw.withColumn(field, whitespace_norm(field)) if collapse_ws else raw


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_train_union(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Training-set scan: several TSVs with headers, unioned by name."""
    return union_by_name([read_delimited(spark, p, schema) for p in paths])


def canonical_projection(df: DataFrame, sentence, city, province, country, region,
                         extra: dict | None = None) -> DataFrame:
    """Positional projection: an int is a column position, a str a
    constant; ``extra`` maps output names to positions."""
    def pick(v):
        return F.col(df.columns[v]) if isinstance(v, int) else F.lit(v)
    cols = [pick(sentence).cast("string").alias("original_sentence"),
            pick(city).cast("string").alias("dialect_city_id"),
            pick(province).cast("string").alias("dialect_province_id"),
            pick(country).cast("string").alias("dialect_country_id"),
            pick(region).cast("string").alias("dialect_region_id")]
    for name, pos in (extra or {}).items():
        cols.append(F.col(df.columns[pos]).alias(name))
    return df.select(*cols)
