"""The canonical sentence table built from the verification tables.

Stand-ins: a sentence is a line of ``documents.text``; city := ``source``,
country := ``lang``, region := germanic (en, de) / romance (other). Exact
copies of a text are removed first (keep the smallest doc_id) and the split
is drawn per document, so copies and lines of one document never straddle
train and test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import compose_label
from ..functions.text import strip_marks, word_tokens
from ..operators.clean import dedupe_keep_first, preclean
from ..operators.split import exact_split
from ..session import materialize
from ..sources.tables import table

KEYS = ["doc_id", "line_no"]


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width (set by the cluster for its data size)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

# Fixed values of the fixture hierarchy.
GERMANIC = ("en", "de")


def region_of(lang: Column) -> Column:
    return F.when(lang.isin(*GERMANIC), F.lit("germanic")).otherwise(F.lit("romance"))


def explode_lines(docs: DataFrame, text_col: str = "text",
                  out_col: str = "original_sentence") -> DataFrame:
    """One row per non-blank line, with its 0-based line number."""
    keep = [c for c in docs.columns if c != text_col]
    return (docs.select(*keep, F.posexplode(F.split(F.col(text_col), "\n", -1))
                        .alias("line_no", out_col))
                .where(F.trim(F.col(out_col)) != ""))


def documents_split(spark: SparkSession, sf_dir: str, train: float = 0.8,
                    dev: float = 0.1, seed: int = 999) -> DataFrame:
    """De-duplicated documents with their split (doc_id, text, lang, source,
    split)."""
    docs = preclean(table(spark, sf_dir, "documents")
                    .select("doc_id", "text", "lang", "source"), ["text"])
    # Which documents stay, and their split, is decided on (doc_id, digest)
    # alone; the texts are shuffled once, by document, for everything downstream.
    digest = F.sha2("text", 256)
    kept = materialize(dedupe_keep_first(docs.select("doc_id", digest.alias("_digest")), "_digest", "doc_id"))
    splits = exact_split(kept.select("doc_id"), "doc_id", train, dev, seed)
    # one row per doc_id, so that repeated ids neither hide nor multiply the join
    side = (kept.groupBy("doc_id").agg(F.collect_set("_digest").alias("_ds"))
                .join(splits.groupBy("doc_id").agg(F.collect_list("split").alias("_splits")), "doc_id"))
    return (docs.repartition(shuffle_partitions(spark), "doc_id").join(side, on="doc_id", how="inner")
                .where(F.array_contains("_ds", digest))
                .select("doc_id", "text", "lang", "source", F.explode("_splits").alias("split")))


def with_labels(lines: DataFrame) -> DataFrame:
    """Lines of documents with the fixture's label columns."""
    return (lines.withColumn("dialect_city_id", F.col("source"))
                 .withColumn("dialect_province_id", F.lit(None).cast("string"))
                 .withColumn("dialect_country_id", F.col("lang"))
                 .withColumn("dialect_region_id", region_of(F.col("lang"))))


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, original_sentence, dialect_*_id) of every document,
    copies included: one scan, no shuffle. Fit and evaluation use
    ``sentences``, where copies are removed and the split is drawn."""
    docs = preclean(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["text"])
    return with_labels(explode_lines(docs)).select(
        *KEYS, "original_sentence", "dialect_city_id", "dialect_province_id", "dialect_country_id",
        "dialect_region_id")


def sentences(spark: SparkSession, sf_dir: str, level: str = "city",
              train: float = 0.8, dev: float = 0.1, seed: int = 999) -> DataFrame:
    """(doc_id, line_no, split, original_sentence, dialect_*_id, label)."""
    lines = explode_lines(documents_split(spark, sf_dir, train, dev, seed))
    return (with_labels(lines).withColumn("label", compose_label(level))
               .select(*KEYS, "split", "original_sentence", "dialect_city_id",
                       "dialect_province_id", "dialect_country_id", "dialect_region_id",
                       "label"))


# Text profiles (the reference uses three normalisations of the sentence).
def profile_text(c: Column, profile: str) -> Column:
    """``raw``: as is; ``tok``: word-tokenised; ``agg``: diacritics stripped,
    then word-tokenised."""
    if profile == "raw":
        return c
    if profile == "tok":
        return word_tokens(c)
    if profile == "agg":
        return word_tokens(strip_marks(c))
    raise ValueError(profile)
