"""Model rows formed batch by batch, and probabilities kept as arrays, against
the plain reading."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietylens.operators import nb as nbo
from varietylens.operators import rowgrams
from varietylens.plans import model

KEYS = ["doc_id", "line_no"]


@pytest.mark.parametrize("names", [3, 1 << 31])
def test_tally(names):
    row, gram = np.array([2, 0, 2, 2, 0]), np.array([1, 0, 1, names - 1, 0])
    got = [x.tolist() for x in rowgrams.tally(row, gram, 3, names)]
    assert got == [[0, 2, 2], [0, 1, names - 1], [2, 2, 1]]
    assert [len(x) for x in rowgrams.tally(row[:0], gram[:0], 3, names)] == [0, 0, 0]


def test_model_rows_across_batches(spark):
    labels = ["a", "b", "c"]
    rows = [(labels[c], f"w:{f}", 1.0 + f + c) for f in range(20) for c in range(3) if (f + c) % 4]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r["feature"]: dict(zip(r["idx"], r["val"])) for r in nbo.model_rows(
            spark.createDataFrame(rows, "label string, feature string, S double"), "label", labels).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 20
    for f in range(20):
        own = {labels.index(c): s for c, name, s in rows if name == f"w:{f}"}
        T = sum(own.values())
        want = {i: math.log(s + 1) - math.log(T - s + 1) + math.log(T + 1) for i, s in own.items()}
        assert got[f"w:{f}"] == pytest.approx({**want, 3: math.log(T + 1)})


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(d, n, f"l{d % 3}", t) for d in range(12) for n, t in enumerate([f"one two w{d % 3}", f"three w{d % 4} é"])]
    df = spark.createDataFrame(rows + [(1, 0, "l1", "again two")], "doc_id long, line_no int, label string, original_sentence string")
    return model.fit(model.ModelSpec(), df, KEYS), df


def test_precomputed_block_is_wide(fitted):
    """One row per sentence is kept, not one per sentence and class."""
    fm, df = fitted
    block = model.precompute_block(fm, df, KEYS, "x")
    assert block.wide.count() == df.count() and block.names == ["x:l0", "x:l1", "x:l2"]
    want = sorted((r["doc_id"], r["line_no"], r["feature"], round(r["value"], 9)) for r in model.proba_block(fm, df, KEYS, "x").collect())
    assert sorted((r["doc_id"], r["line_no"], r["feature"], round(r["value"], 9)) for r in block.table.collect()) == want
    joined = block.of(df, [*KEYS, "label"]).collect()
    assert len(joined) == df.alias("a").join(block.table, KEYS).count()


def test_wide_sums(fitted):
    """Arrays add up as the long table does, repeated keys too."""
    fm, df = fitted
    block = model.precompute_block(fm, df, KEYS, "x")
    nb = nbo.nb_fit(block.of(df, [*KEYS, "label"]), df, "label", 3)
    got = {(r["doc_id"], r["line_no"]): (r["_X"], *r["sums"]) for r in nbo.wide_model_sums(block.wide, block.names, KEYS, nb).collect()}
    want = {(r["doc_id"], r["line_no"]): (r["_X"], *r["sums"]) for r in nbo.long_model_sums(block.table, KEYS, nb).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_probabilities(fitted):
    """Probabilities of a row add up to one, rows of repeated keys too."""
    fm, df = fitted
    for r in nbo.nb_proba(model.margins(fm, df, KEYS), KEYS, fm.nb).groupBy(*KEYS).agg(
            F.sum("proba").alias("p"), F.count(F.lit(1)).alias("n")).collect():
        assert r["p"] == pytest.approx(r["n"] / 3)


def test_city_layer_is_the_main_fit(monkeypatch):
    """The layer at the main model's level is not fitted a second time."""
    from types import SimpleNamespace

    from varietylens.plans import q_model, q_stack
    fit = object()
    monkeypatch.setattr(q_model, "fitted", lambda spark, sf_dir, spec: fit)
    monkeypatch.setattr(q_stack, "_ST", {})
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none"))
    assert q_stack.layer_model(session, "none", "city") is fit
