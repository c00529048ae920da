"""Layers with language models, out-of-fold features, block-additive margins."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from varietylens.functions.labels import compose_label
from varietylens.operators import nb as nbo
from varietylens.plans import layers as Y
from varietylens.plans import model

KEYS = ["doc_id", "line_no"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Labels that nothing in the text tells, and a word of its own per row."""
    rng = np.random.default_rng(1)
    rows = [(i, 0, f"only{i}x " + " ".join(rng.choice(["da", "di", "do", "du"], 6)), str(rng.choice(["a", "b"])), "p", "xx",
             str(rng.choice(["north", "south", "west"])), i % 3) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, original_sentence string, dialect_city_id string, "
                                       "dialect_province_id string, dialect_country_id string, dialect_region_id string, fold int").cache()


def _right(block, corpus):
    """Share of rows whose own class has the highest probability."""
    best = (block.table.groupBy(*KEYS).agg(F.max_by("feature", "value").alias("f")).join(corpus, KEYS)
                 .agg(F.avg((F.col("f") == F.concat(F.lit("L0:"), F.col("dialect_region_id"))).cast("int")).alias("r")))
    return best.first()["r"]


def test_out_of_fold_features_do_not_know_their_rows(corpus):
    spec = Y.LayerSpec("region")
    none = corpus.limit(0)
    seen = Y.layer_block(spec, Y.fit_layer(spec, corpus, KEYS), corpus, KEYS, "L0")
    held = Y.out_of_fold(spec, corpus, none, KEYS, "L0", F.col("fold"), 3)
    assert _right(seen, corpus) > 0.9  # it has learned each row's own word by heart
    assert _right(held, corpus) < 0.6
    assert held.table.count() == seen.table.count() == 150 * 3


def test_out_of_fold_equals_layers_of_the_other_folds(corpus):
    spec = Y.LayerSpec("region")
    held = Y.out_of_fold(spec, corpus.where("doc_id < 120"), corpus.where("doc_id >= 120"), KEYS, "L0", F.col("fold"), 3)
    got = {(r["doc_id"], r["feature"]): r["value"] for r in held.table.collect()}
    for train, rows in (("doc_id < 120 and fold <> 1", "doc_id < 120 and fold = 1"), ("doc_id < 120", "doc_id >= 120")):
        fitted = Y.fit_layer(spec, corpus.where(train), KEYS)
        for r in Y.layer_features(spec, fitted, corpus.where(rows), KEYS, "L0").collect():
            assert got[r["doc_id"], r["feature"]] == pytest.approx(r["value"], abs=1e-9)


def test_layer_flags_choose_blocks(corpus):
    fitted = Y.fit_layer(Y.LayerSpec("region", lm_order=2, exclude=("west",), use_lm=True), corpus, KEYS)
    assert fitted.labels == ["north", "south", "west"] and fitted.lm_labels == ["north", "south"]

    def names(**flags):
        spec = Y.LayerSpec("region", lm_order=2, exclude=("west",), **flags)
        found = {r["feature"] for r in Y.layer_features(spec, fitted, corpus.limit(3), KEYS, "L1").select("feature").distinct().collect()}
        assert len(found) == Y.n_features(spec, fitted)
        return found
    distr = {f"L1:{x}" for x in ("north", "south", "west")}
    lm = {f"L1l{u}:{x}" for u in "wc" for x in ("north", "south")}
    assert names(use_lm=False) == distr and names(use_lm=True) == distr | lm and names(use_distr=False, use_lm=True) == lm
    with pytest.raises(ValueError):
        Y.fit_layer(Y.LayerSpec("region", use_lm=True), corpus, KEYS)


def test_subset_margins_are_those_of_whole_fits(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, 0, str(rng.choice(list("abc")))) for i in range(60)], "doc_id long, line_no int, label string")
    tables = {b: spark.createDataFrame([(i, 0, f"{b}:{f}", float(rng.random())) for i in range(60) for f in rng.choice(9, 4, replace=False)],
                                       "doc_id long, line_no int, feature string, value double") for b in ("x", "y", "z")}
    models = {b: nbo.nb_fit(t.join(docs, KEYS), docs, "label", 9) for b, t in tables.items()}
    sums = docs.select(*KEYS)
    for b, t in tables.items():
        part = nbo.nb_sums(t, docs, KEYS, models[b])
        sums = sums.join(part.select(*KEYS, *[F.col(f"_{v}").alias(f"{v}_{b}") for v in "XZD"]), KEYS)
    subsets = {"x": ["x"], "xz": ["x", "z"], "xyz": ["x", "y", "z"]}
    got = {(r["subset"], r["doc_id"]): r["margins"] for r in nbo.subset_margins(sums, KEYS, models, subsets).collect()}
    for name, blocks in subsets.items():
        x = tables[blocks[0]]
        for b in blocks[1:]:
            x = x.unionByName(tables[b])
        whole = nbo.nb_fit(x.join(docs, KEYS), docs, "label", 9 * len(blocks))
        for r in nbo.nb_margins(x, docs, KEYS, whole).collect():
            assert np.allclose(got[name, r["doc_id"]], r["margins"], atol=1e-9)


def test_coarser_fit_adds_up_the_finer_sums(spark, monkeypatch):
    """A layer of the main model's rows reads no text; ambiguous labels are fitted anew."""
    rows = [(i, 0, f"{w} {v} x", c, lang, reg) for i, (w, v, c, lang, reg) in enumerate(
        [("a", "b", "c1", "en", "g"), ("b", "c", "c1", "en", "g"), ("a", "d", "c2", "de", "g"), ("e", "f", "c3", "fr", "r"), ("f", "a", None, "fr", "r")])]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, original_sentence string, dialect_city_id string, "
                                     "dialect_country_id string, dialect_region_id string")
    main = model.fit(model.ModelSpec(), df.withColumn("label", compose_label("city")), KEYS)
    plain = {lv: Y.fit_layer(Y.LayerSpec(lv), df, KEYS) for lv in ("country", "region")}
    odd = df.withColumn("_fine", F.lit("same")).withColumn("label", compose_label("region"))
    assert model.coarser_sums(main, "_fine", odd, model.ModelSpec(level="region")) is None
    monkeypatch.setattr(model, "text_blocks", None)
    for lv, want in plain.items():
        got = Y.fit_layer(Y.LayerSpec(lv), df, KEYS, main)
        assert got.labels == want.labels and got.nb.n_features == want.nb.n_features
        assert np.allclose(got.nb.k, want.nb.k) and np.allclose(got.nb.log_prior, want.nb.log_prior)
        a, b = ({(r["label"], r["feature"]): r["S"] for r in m.nb.stats.collect()} for m in (got, want))
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
