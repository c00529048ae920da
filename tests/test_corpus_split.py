"""The corpus split: texts move once, and repeated keys give the rows that the
plain joins give."""
from pyspark.sql import functions as F

from varietylens.operators.clean import dedupe_keep_first
from varietylens.operators.split import exact_split
from varietylens.plans import corpus


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, f"text {i}\nline", "en", "s1") for i in range(30)] + [
        (3, "text 3\nline", "en", "s1"), (3, "another", "fr", "s2"), (40, "text 5\nline", "de", "s2"),
        (None, "nobody's", "en", "s1"), (None, "text 1\nline", "en", "s1"), (41, None, "en", "s1"), (42, "", "es", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.documents_split(spark, str(tmp_path))
    plain = dedupe_keep_first(docs.where("text IS NOT NULL"), "text", "doc_id")
    want = plain.join(exact_split(plain.select("doc_id"), "doc_id", 0.8, 0.1, 999), "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_texts_are_shuffled_once(spark):
    plan = corpus.documents_split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x]
    assert len(moved) == 1 and "sha2(cast(text" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(sha2" in x or "Exchange hashpartitioning(_d" in x]
