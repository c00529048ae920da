import math

import numpy as np
from pyspark.sql import functions as F

from varietylens.operators import nb as nbo


def numpy_ovr_nb(X, y, classes):
    """Brute force: one binary multinomial NB (alpha 1, fitted prior) per
    class, dense weights."""
    out = []
    for c in classes:
        pos, neg = X[y == c], X[y != c]
        fp, fn = pos.sum(0), neg.sum(0)
        F_ = X.shape[1]
        wp = np.log((fp + 1) / (fp.sum() + F_))
        wn = np.log((fn + 1) / (fn.sum() + F_))
        b = math.log(len(pos) / len(neg))
        out.append(b + X @ (wp - wn))
    return np.array(out).T   # docs x classes margins


def test_sparse_margins_equal_dense(spark):
    rng = np.random.default_rng(0)
    n, F_, classes = 40, 12, ["a", "b", "c"]
    X = rng.poisson(0.7, size=(n, F_)).astype(float)
    X[3] = 0.0                                  # a document without features
    y = np.array([classes[i % 3] for i in range(n)])
    rows = [(i, str(y[i]), f"f{j}", float(X[i, j])) for i in range(n) for j in range(F_) if X[i, j] > 0]
    x = spark.createDataFrame(rows, "doc long, label string, feature string, value double")
    docs = spark.createDataFrame([(i, str(y[i])) for i in range(n)], "doc long, label string")
    m = nbo.nb_fit(x, docs, "label", F_, materialize_tables=False)
    got = {r["doc"]: r["margins"] for r in nbo.nb_margins(x.drop("label"), docs, ["doc"], m).collect()}
    want = numpy_ovr_nb(X, y, classes)
    for i in range(n):
        assert np.allclose(got[i], want[i], rtol=1e-12, atol=1e-9)
    # probabilities sum to one; hard prediction picks the largest posterior
    prob = nbo.nb_proba(nbo.nb_margins(x.drop("label"), docs, ["doc"], m), ["doc"], m)
    sums = prob.groupBy("doc").agg(F.sum("proba").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_two_class_prediction_rule(spark):
    rows = [(0, "a", "f0", 2.0), (1, "b", "f1", 3.0), (2, "a", "f0", 1.0)]
    x = spark.createDataFrame(rows, "doc long, label string, feature string, value double")
    docs = x.select("doc", "label")
    m = nbo.nb_fit(x, docs, "label", 2, materialize_tables=False)
    mg = nbo.nb_margins(x.drop("label"), docs, ["doc"], m)
    pred = {r["doc"]: r["pred"] for r in nbo.nb_predict(mg, ["doc"], m).collect()}
    assert pred == {0: "a", 1: "b", 2: "a"}


def test_features_of_few_classes(spark):
    """A feature's model row holds the classes that have it and no other."""
    rng = np.random.default_rng(1)
    n, F_, classes = 30, 10, ["a", "b", "c"]
    X = rng.poisson(0.5, size=(n, F_)).astype(float)
    y = np.array([classes[i % 3] for i in range(n)])
    X[y != "a", 0] = 0.0                       # feature 0 only ever seen by class a
    rows = [(i, str(y[i]), f"f{j}", float(X[i, j])) for i in range(n) for j in range(F_) if X[i, j] > 0]
    x = spark.createDataFrame(rows, "doc long, label string, feature string, value double")
    docs = spark.createDataFrame([(i, str(y[i])) for i in range(n)], "doc long, label string")
    m = nbo.nb_fit(x, docs, "label", F_, materialize_tables=False)
    assert m.feat.where("feature = 'f0'").first()["idx"] == [0, 3]
    got = {r["doc"]: r["margins"] for r in nbo.nb_margins(x.drop("label"), docs, ["doc"], m).collect()}
    want = numpy_ovr_nb(X, y, classes)
    for i in range(n):
        assert np.allclose(got[i], want[i], rtol=1e-12, atol=1e-9)


def test_underflow_and_nan_posteriors(spark):
    nan = float("nan")
    rows = [(1, [-800.0, -900.0, -1000.0]), (2, [nan, 1.0, 2.0]), (3, [nan, nan, nan]), (4, [3.0, 0.0, 3.0])]
    margins = spark.createDataFrame(rows, "doc long, margins array<double>")
    x = spark.createDataFrame([(i, c, "f", 1.0) for i, c in enumerate("abc")], "doc long, label string, feature string, value double")
    docs = spark.createDataFrame(list(enumerate("abc")), "doc long, label string")
    m = nbo.nb_fit(x, docs, "label", 1, materialize_tables=False)
    hard = {r["doc"]: r["pred"] for r in nbo.nb_predict(margins, ["doc"], m).collect()}
    assert (hard[2], hard[3], hard[4]) == ("c", None, "c")  # the last class wins ties
    top = {r["doc"]: r for r in nbo.nb_top(margins, ["doc"], m).collect()}
    assert top[1]["top"] is None and top[3]["top"] is None and top[4]["top"] == "a"
    proba = [r["proba"] for r in nbo.nb_proba(margins.where("doc = 1"), ["doc"], m).collect()]
    assert proba == [None, None, None]
