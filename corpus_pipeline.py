"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup,
substring dedup, mixing, packing. Each stage takes (spark, docs, sf_dir) and
works on all rows its predecessor kept; all but the last return the columns
of documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietylens.llm import langid, mixing, packing, paragraphs, simhash
from varietylens.llm.common import fresh, materialize
from varietylens.llm.queries import tokenizer_path

#: Texts whose best language has less than this share of the evidence go.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; no letters, no language."""
    out = langid.predict(docs, langid.train(docs))
    pred, score = out.columns[-2:]
    return out.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash group."""
    return simhash.keep_one(docs, width=3, max_bits=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a document of which no
    word is left goes."""
    out = paragraphs.dedupe(docs)
    cut = F.col(out.columns[len(docs.columns)]) > 0
    left = out.where(~cut | F.col("text").rlike(mixing.WORD))
    return left.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) \
               .select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mixing.mix(docs)
    copies = out.columns[-1]
    again = fresh(out, "again")
    return out.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    cut = packing.pieces(docs, tokenizer_path(), size=1024, end_id=0, digest=True)
    return packing.place(cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"), size=1024,
                         order=("doc_id", "start", "ids_crc32"))


STAGES = [("language_id", language_id), ("simhash", simhash_dedup), ("substring_dedup", substring_dedup),
          ("mixing", mix_sources), ("packing", pack)]

#: No stage is a SQL query (learned model, XXH64, MinHash, knapsack, tokenizer);
#: tests/llm compares each with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
