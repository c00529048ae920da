"""Block sums against a plain reading: long rows, repeats, unknown features,
rows without features, repeated keys, small blocks and small slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietylens.operators import additive


def plain(rows, table, width):
    out = []
    for key, features, weights in rows:
        v = np.zeros(width)
        for f, w in zip(features, weights):
            for i, c in table.get(f, ()):
                v[i] += w * c
        out.append((key, tuple(np.round(v, 9))))
    return sorted(out)


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("cells", [4, 1 << 22])
def test_block_sums(spark, monkeypatch, weighted, cells):
    monkeypatch.setattr(additive, "LONG_ROW", 40)
    monkeypatch.setattr(additive, "CELLS", cells)     # blocks of one row, slices of few entries
    rng = np.random.default_rng(3)
    width = 4
    table = {f"f{j}": [(int(i), float(rng.normal())) for i in rng.permutation(width)[:rng.integers(1, width + 1)]]
             for j in range(30)}
    rows = []
    for key in range(60):
        n = 0 if key % 9 == 0 else 200 if key % 13 == 0 else int(rng.integers(1, 30))
        features = ["hot", *(f"f{j}" for j in rng.integers(0, 40, n))] if n else []
        rows.append((key // 2, features, [float(w) if weighted else 1.0 for w in rng.random(len(features))]))
    table["hot"] = [(0, 1.0), (3, -2.0)]
    d = spark.createDataFrame(rows, "k long, features array<string>, weights array<double>").repartition(3)
    if not weighted:
        d = d.drop("weights")
    t = spark.createDataFrame([(f, [i for i, _ in e], [c for _, c in e]) for f, e in table.items()],
                              "feature string, idx array<int>, val array<double>")
    got = sorted((r["k"], tuple(np.round(r["sums"], 9))) for r in additive.block_sums(d, ["k"], t, width).collect())
    assert got == plain(rows, table, width)


def test_no_rows_and_no_model(spark):
    d = spark.createDataFrame([(1, ["a"])], "k long, features array<string>")
    t = spark.createDataFrame([], "feature string, idx array<int>, val array<double>")
    assert additive.block_sums(d, ["k"], t, 2).first()["sums"] == [0.0, 0.0]
    assert additive.block_sums(d.where(F.lit(False)), ["k"], t, 2).collect() == []


def test_long_rows_have_a_block_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(additive, "LONG_ROW", 3)
    d = spark.createDataFrame([(i, ["a"] * (5 if i % 4 == 0 else 2)) for i in range(16)],
                              "k long, features array<string>").coalesce(1)
    blocks = {}
    for r in additive.with_blocks(d, 2).collect():
        blocks.setdefault(r["_block"], []).append(r["k"])
    assert sorted(map(len, blocks.values())) == [1, 1, 1, 1, 12]
