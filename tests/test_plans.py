"""Physical-plan checks: pruning/pushdown reach the scan, and per-sentence
aggregations over the bucketed corpus run without a shuffle."""

from pyspark.sql import functions as F

from varietylens.operators.ngrams import char_term_counts
from varietylens.plans import corpus
from varietylens.session import materialize_bucketed
from varietylens.sources.tables import table

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pruning_and_pushdown(spark):
    df = table(spark, SF, "documents").where(F.col("doc_id") > 5).select("doc_id", "lang")
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_bucketed_corpus_aggregates_without_shuffle(spark):
    s = materialize_bucketed(corpus.sentences(spark, SF), "doc_id", 4)
    tf = char_term_counts(s, corpus.KEYS, "original_sentence", 1, 3)
    assert "Exchange" not in plan_of(tf)
    assert tf.count() > 0
