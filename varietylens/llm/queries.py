"""Registered queries of the operators: each applies its operator to a whole
table with production parameters and derives the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, embeddings, langid, mixing, onebit, packing, paragraphs, sharding, simhash, toxicity, warc, whitening,
               winnowing)
from .common import crc_of_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 24


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register
def op1_embedding_neardup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@register
def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, cap=2.0)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
                        "source")


@register
def op3_paragraph_dedup(spark, sf_dir):
    cut = paragraphs.dedupe(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "cut_words", "cut_passages", "cut_first_ids", F.sha2("text", 256).alias("text_sha256"),
                      "text")


@register
def op4_sharding(spark, sf_dir):
    raw = F.col("text").cast("binary")
    grown = [1.0] * (SHARDS + 1)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        sharding.rendezvous([F.col("doc_id")], grown[:SHARDS]).alias("shard"),
        sharding.rendezvous([F.col("doc_id")], grown).alias("grown_shard"))
    out = sharding.numbered(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register
def op5_toxicity(spark, sf_dir):
    crc = crc_of_id(F.col("doc_id"))
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=crc % 5 != 0,
                         fold=(crc % 5 - 1).cast("int"))
    return out.select("doc_id", langid.held_out(crc, 5, 0).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


@register
def op6_winnowing(spark, sf_dir):
    out = winnowing.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


@register
def op7_simhash(spark, sf_dir):
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op8_packing(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end_id=0, digest=True)
    return packing.place(cut, size=1024, order=("doc_id", "start", "ids_crc32")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register
def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    held = F.col("record_type") == "response"  # what it holds is measured; a revisit names what it refers to
    return warc.lookup(warc.write(pages), pages).select(
        "page_id", F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


@register
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crc = crc_of_id(F.col("doc_id"))
    model = langid.train(docs.where(crc % 4 != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(crc, 4, 2).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))


@register
def op11_token_alignment(spark, sf_dir):
    out = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return out.documents.withColumnRenamed("groups", "groups_sha256")


@register
def op12_onebit_search(spark, sf_dir):
    return onebit.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register
def op13_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, components=8)
    out = whitening.transform(rows.select("vec_id", "embedding"), model).where("whitened is not null")
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    return out.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")) \
        .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
