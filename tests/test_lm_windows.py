"""Language models from windows: the same n-grams, counts and discounts as counted
one by one; places held together; LM features as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varietylens.operators import lm as L
from varietylens.operators import nb as N
from varietylens.session import materialize

# a token written as <s> is; a unit, a label without more than one line; an empty line
ROWS = [("word", "x", "a b c a b d".split()), ("word", "x", "b <s> a b".split()), ("word", "y", "a b c".split()), ("word", "y", []),
        ("char", "x", list("abcabd")), ("word", "x", "a b c a b d".split()), ("word", None, ["b"]), ("word", "z", None)]
SCHEMA = "unit string, label string, toks array<string>"


def test_windows_end_with_every_shorter_gram(spark):
    """Each token is shuffled with one window, however many orders end there."""
    df = spark.createDataFrame(ROWS, SCHEMA).where("label IS NOT NULL")
    for order in (1, 2, 3, 5):
        want = {(r["unit"], r["label"], r["n"], r["gram"]): r["c"] for r in L.ngram_counts(df, order).collect()}
        windows = L._batch_windows(df, order).collect()
        got = {}
        for r in windows:
            toks = r["gram"].split(" ")
            for n in range(1, len(toks) + 1):
                key = (r["unit"], r["label"], n, " ".join(toks[-n:]))
                got[key] = got.get(key, 0) + r["c"]
        assert got == want
        assert order < 3 or len(windows) < len(want)


def test_discounts_equal_those_of_grams_counted_one_by_one(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for order in (1, 2, 4):
        plain = L.discounts(L.adjusted_counts(L.ngram_counts(df.where("label IS NOT NULL"), order), order))
        want = {tuple(r) for r in plain.collect()}
        assert {tuple(r) for r in L.sentence_discounts(df, order).select(*plain.columns).collect()} == want
        fit = L.fitted_windows(df, order)
        assert {tuple(r) for r in fit.disc.select(*plain.columns).collect()} == want
        grams = {tuple(r) for r in L.ngram_counts(df.where("label IS NOT NULL"), order).select("unit", "label", "n", "gram").collect()}
        assert {tuple(r) for r in L.estimate(df, order)[0].select("unit", "label", "n", "gram").collect()} == grams


def test_places_are_whole_and_added_up(monkeypatch):
    monkeypatch.setattr(L, "HELD", 8)
    k = [1] * 3 + [2] * 40 + [3] * 2 + [4] * 9
    t = pa.table([pa.array(k, pa.int64()), pa.array(["word"] * len(k)), pa.array(["x"] * len(k)),
                  pa.array([f"g{i % 3}" for i in range(len(k))]), pa.array([1] * len(k), pa.int64())], ["_k", "unit", "label", "gram", "c"])
    for size in (1, 4, 7, 100):
        parts = list(L._whole_places(t.to_batches(max_chunksize=size)))
        places = [set(p["_k"].to_pylist()) for p in parts]
        assert sum(len(p) for p in places) == len(set.union(*places)) == 4
        assert sum(sum(p["c"].to_pylist()) for p in parts) == len(k)
        assert size > 8 or max(len(p) for p in parts) < 24


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}
    before = files()
    got = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert got.count() == 7


def test_features_are_normalised_rows():
    got = L.normal_exp(np.array([[-1.0, -2.0], [-1e5, -1e5], [-np.inf, 0.0]]))
    e = np.exp([-1.0, -2.0])
    assert np.allclose(got, [e / np.sqrt((e * e).sum()), [0, 0], [0, 1]])


def test_arrays_sum_as_long_rows_do(spark):
    names = ["lw:a", "lw:b", "lw:none"]
    rows = [(1, 1, "a", [0.5, 0.25, 0.0]), (1, 2, "b", [0.0, 0.0, 0.0]), (2, 1, "b", [0.1, 0.9, 0.3]), (2, 1, "b", [0.2, 0.1, 0.0])]
    wide = spark.createDataFrame(rows, "doc_id long, line_no long, label string, probas array<double>")
    long = wide.select("doc_id", "line_no", "label", F.posexplode("probas").alias("i", "value")).select(
        "doc_id", "line_no", "label", F.array(*[F.lit(n) for n in names])[F.col("i")].alias("feature"), "value")
    model = N.nb_fit(long.where("feature <> 'lw:none'"), wide.select("label"), "label", 2, False)
    keys = ["doc_id", "line_no"]
    a, b = ({(r["doc_id"], r["line_no"]): [r["_X"], *r["sums"]] for r in d.collect()} for d in (
        N.array_model_sums(wide, names, keys, model), N.long_model_sums(long, keys, model)))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in a)
    got = N.array_label_values(wide, names, "label").groupBy("label", "feature").agg(F.sum("value").alias("v"))
    want = {(r["label"], r["feature"]): r["v"] for r in long.groupBy("label", "feature").agg(F.sum("value").alias("v")).collect()}
    assert all(abs(r["v"] - want[r["label"], r["feature"]]) < 1e-12 for r in got.collect()) and got.count() == len(want)
