"""Model rows that nearly all classes have, added up whole."""
import numpy as np
import pytest

from varietylens.operators import additive
from varietylens.operators.additive import add_up


@pytest.mark.parametrize("cells", [3, 50, 1 << 22])
@pytest.mark.parametrize("weights", ["one", "odd", "nan"])
def test_full_and_sparse_model_rows(monkeypatch, cells, weights):
    monkeypatch.setattr(additive, "CELLS", cells)
    called = []
    inner = additive._add_full
    monkeypatch.setattr(additive, "_add_full", lambda *a: (called.append(1), inner(*a)))
    rng, width = np.random.default_rng(3), 9
    lengths = np.array([0, 1, 9, 7, 2, 9, 11])              # 11: classes named twice
    index = np.concatenate([rng.permutation(width)[:k] if k <= width else np.arange(k) % width for k in lengths])
    value = rng.normal(size=int(lengths.sum()))
    counts = np.array([0, 5, 0, 1, 12, 3, 0])
    at = rng.integers(-1, len(lengths), int(counts.sum()))
    w = np.ones(len(at)) if weights == "one" else rng.normal(size=len(at))
    if weights == "nan":
        w[4] = np.nan
    want, row = np.zeros((len(counts), width)), np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(lengths) - lengths
    for r, m, x in zip(row, at, w):
        for j in range(start[m], start[m] + lengths[m]) if m >= 0 else ():
            want[r, index[j]] += x * value[j]
    got = add_up(counts, at, w, lengths, index, value, width)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
    assert bool(called) == (weights != "nan")
