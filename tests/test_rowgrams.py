"""Terms of rows against a plain count, and the block path of TF-IDF and naive
Bayes against the long table."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varietylens.operators import nb as nbo
from varietylens.operators import rowgrams, tfidf
from varietylens.plans import model

KEYS = ["doc_id", "line_no"]
TEXTS = ["a b  a", "", " ", "x\t\ty\n z", "𝄞é é é", "aaaa", "un dos tres quatre", "\x00\x0b\x0c-"]


def plain(texts, unit, lo, hi):
    out = Counter()
    for t in texts:
        if unit == "w":
            seq, sep = t.split(" "), " "
        else:
            import re
            seq, sep = list(re.sub(r"[ \t\n\x0b\f\r]{2,}", " ", t)), ""
        for n in range(lo, hi + 1):
            out.update(sep.join(seq[i:i + n]) for i in range(len(seq) - n + 1))
    return out


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
@pytest.mark.parametrize("unit,lo,hi", [("w", 1, 1), ("w", 1, 3), ("c", 1, 3), ("c", 2, 5)])
def test_row_terms(monkeypatch, size, unit, lo, hi):
    monkeypatch.setattr(rowgrams, "SLICE", size)
    rows = [[t] for t in TEXTS] + [TEXTS[:3], [], TEXTS]
    got = [Counter() for _ in rows]
    for _, _, row, term, tf, names in rowgrams.row_terms(pa.array(rows, pa.list_(pa.string())), unit, lo, hi):
        for r, t, n in zip(row.tolist(), names.take(pa.array(term)).to_pylist(), tf.tolist()):
            assert t not in got[r]
            got[r][t] = n
    assert got == [plain(r, unit, lo, hi) for r in rows]


def test_a_slice_is_sorted_once(monkeypatch):
    """Shorter n-grams are the beginnings of the longest ones."""
    calls, tally = [], rowgrams.tally
    monkeypatch.setattr(rowgrams, "tally", lambda *a: calls.append(1) or tally(*a))
    assert len(list(rowgrams.row_terms(pa.array([[t] for t in TEXTS]), "c", 1, 3))) == 3
    assert len(calls) == 1


def test_compact():
    key = np.array([5, 2, 5, 9])
    for space in (10, 1 << 40):
        found, at = rowgrams.compact(key, space)
        assert found.tolist() == [2, 5, 9] and found[at].tolist() == key.tolist()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, " ".join(rng.choice(["da", "di", "do", "du,", "È"], 1 + i % 7)), "abc"[i % 3]) for i in range(60)]
    rows += [(60, 0, "\t", "a"), (61, 0, None, "b"), (1, 0, "di di twice", "a")]       # no text, no words, a repeated key
    return spark.createDataFrame(rows, "doc_id long, line_no int, original_sentence string, label string").cache()


@pytest.mark.parametrize("long_text", [2, 1 << 12])
def test_blocks_equal_the_long_table(spark, corpus, monkeypatch, long_text):
    monkeypatch.setattr(tfidf, "LONG_TEXT", long_text)     # nearly every row a block of its own
    fitted = model.fit(model.ModelSpec(), corpus.where("doc_id % 4 > 0"), KEYS)
    prepped = model._prep(corpus, fitted.spec)
    parts = [tfidf.tfidf_values(model.block_tf(b, fitted.spec, prepped, KEYS), fitted.vocabs[b], KEYS, b) for b in "wc"]
    want = parts[0].unionByName(parts[1])
    got = model.feature_table(fitted, corpus, KEYS)

    def rows(x):
        return {(r["doc_id"], r["line_no"], r["feature"]): round(r["value"], 9) for r in x.collect()}
    assert rows(got) == rows(want) and got.count() == want.count() == len(rows(want))
    m = {r["doc_id"]: r["margins"] for r in nbo.nb_margins(want, corpus, KEYS, fitted.nb).collect()}
    for r in model.margins(fitted, corpus, KEYS).collect():
        assert np.allclose(r["margins"], m[r["doc_id"]], atol=1e-9)


def test_margins_have_no_row_per_term(spark, corpus):
    """Terms are summed inside blocks: nothing explodes them into rows."""
    fitted = model.fit(model.ModelSpec(), corpus, KEYS)
    plan = model.margins(fitted, corpus, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_a_model_of_the_same_rows_lends_its_sums(spark, corpus):
    base = model.fit(model.ModelSpec(), corpus, KEYS)
    sub = model.fit(model.ModelSpec(char=None), corpus, KEYS)
    block = [("x", sub)]
    whole, lent = (model.fit(model.ModelSpec(), corpus, KEYS, stacked=block, reuse=r) for r in (None, base))
    a, b = ({(r["label"], r["feature"]): round(r["S"], 9) for r in m.nb.stats.collect()} for m in (whole, lent))
    assert a == b and any(f.startswith("x:") for _, f in a)
    assert whole.nb.n_features == lent.nb.n_features
