"""Large band groups of substring dedup: exact split, streamed counting, odd
rows."""
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varietylens.llm import paragraphs


def jaccard(x, y):
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


def test_left_out_shingles_join_all_and_only_close_sets():
    rng = np.random.default_rng(1)
    sets = []
    for n in range(1, 13):
        base = rng.integers(1, 1 << 62, 14).astype(np.uint64)
        for _ in range(6):
            x = base[:n].copy()
            for _ in range(rng.integers(0, 3)):
                x[rng.integers(0, n)] = rng.integers(1, 1 << 62)
            sets.append(np.unique(x))
        sets += [np.unique(base[:max(1, n - d)]) for d in (0, 1, 2)]
    keys = {}
    for key, i, whole in paragraphs.left_out(sets):
        keys.setdefault(key % (1 << 64), []).append((i, whole))
    joined = {tuple(sorted((i, j))) for rows in keys.values() for (i, a), (j, b) in itertools.combinations(rows, 2) if i != j and (a or b)}
    close = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= 0.8}
    assert joined == close and len(close) > 50


def test_anchors_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(4)
    for high in (6, 50, 1 << 60):
        sizes = rng.choice([0, 1, 2, 30, 34, 35, 36, 70, 300], 40)
        first = np.append(0, np.cumsum(sizes))
        x = rng.integers(1, high, first[-1]).astype(np.uint64)
        at, row = paragraphs._all_anchors(x, first)
        want = [(i, int(first[i] + a)) for i in range(40) if sizes[i] for a in paragraphs._anchors(x[first[i]:first[i + 1]])]
        assert list(zip(row.tolist(), at.tolist())) == want


def test_verifying_by_pairs_and_groups_is_exact():
    rng = np.random.default_rng(5)
    rows = []
    for key in range(60):
        base = [f"{rng.integers(0, 1 << 30):x}" for _ in range(16)]
        for _ in range(2 if key % 3 else rng.integers(1, 7)):
            w = base.copy()
            for _ in range(rng.integers(0, 2)):
                w[rng.choice([0, 1, 14, 15])] = f"{rng.integers(0, 1 << 30):x}"
            rows.append((key, len(rows), " ".join(w[:rng.integers(3, 17)] if rng.random() < 0.2 else w)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "par", "body"])
    got = [(r["a"], r["b"]) for b in paragraphs._verify(iter([batch])) for r in b.to_pylist()]
    sets = paragraphs._sets(batch.column(2))
    close = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] == rows[j][0]
             and len(sets[i]) and len(sets[j]) and jaccard(sets[i], sets[j]) >= 0.8]

    def classes(pairs):
        lab = list(range(len(rows)))
        for _ in rows:
            for i, j in pairs:
                lab[i] = lab[j] = min(lab[i], lab[j])
        return lab
    assert set(map(frozenset, got)) <= set(map(frozenset, close)) and classes(got) == classes(close) and len(close) > 20


def test_gap_hashes_stand_for_their_words():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(["x", "y", *words]), " ".join([*words[:200], "other", *words[201:]])]
    got = []
    for batch in paragraphs._places(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], names=["d", "i", "t"])])):
        got += batch.to_pylist()
    gaps = [{(r["par"], r["gap"], texts[d - 1][r["end"]:r["upto"]].strip()) for r in got if r["doc"] == d} for d in (1, 2, 3)]
    assert len(gaps[0] & gaps[1]) >= len(gaps[0]) - 2 and gaps[2] - gaps[0] and gaps[2] & gaps[0]
    seen = {}
    assert all(seen.setdefault(g, t) == t for x in gaps for _, g, t in x)


def test_meeting_paragraphs_are_counted_across_batches(monkeypatch):
    monkeypatch.setattr(paragraphs, "GROUP", 3)
    rng = np.random.default_rng(2)
    rows = sorted((int(k), int(p), bool(m)) for k, p, m in zip(
        rng.choice([0, 1, 4, 8, 9, 12, 16, 20, 24, 28], 60), rng.integers(0, 9, 60), rng.random(60) < 0.1))
    rows = [r for r in rows if r[0] != 16 or r[1] == 5]
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], names=["key", "par", "many"])
                   for i in range(0, len(rows), size)]
        got = [r for b in paragraphs._meet(iter(batches)) for r in b.to_pylist()]
        pars = {}
        for k, p, m in rows:
            pars.setdefault(k, {}).setdefault(p, []).append(m)
        want = {(k, p, len(ps) > 1, k % 4 == 0 and (len(x) > 1 or any(x))) for k, ps in pars.items() for p, x in ps.items()}
        assert {(r["key"], r["par"], r["near"], r["exact"]) for r in got if r["size"] is None} == {w for w in want if w[2] or w[3]}
        assert {r["key"]: r["size"] for r in got if r["size"] is not None} == {k: len(p) for k, p in pars.items() if len(p) > 3}
        assert len({(r["key"], r["par"]) for r in got}) == len(got)


def test_a_line_in_ever_other_surroundings_is_found_everywhere(spark):
    """More paragraphs in a band group than one task verifies, each pair of
    Jaccard 11/13."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))

    def spans(text):
        _, lo, hi, *_ = paragraphs.cut(*paragraphs.text_bytes(pa.array([text])))
        return list(zip(lo.tolist(), hi.tolist()))

    line, n = [word() for _ in range(15)], paragraphs.GROUP * 2
    while spans(" ".join([*line, word()])) != [(0, 16)]:  # the line's own word pairs hold the anchor
        line = [word() for _ in range(15)]
    rows = [(i, " ".join([*line, word()])) for i in range(n)] + [(n + i, " ".join(word() for _ in range(16))) for i in range(200)]
    whole = [i for i, t in rows[:n] if spans(t) == [(0, 16)]]
    assert len(whole) > paragraphs.GROUP * 1.5
    got = paragraphs.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    cut = got.set_index("doc_id").cut_words.sort_index()
    # what MinHash misses: no band without the paragraph's own word
    assert cut[whole[0]] == 0 and set(cut[whole[1:]]) <= {0, 16} and (cut[whole[1:]] == 16).mean() > 0.998
    assert (cut[n:] == 0).all() and len(got) == len(rows)


def test_odd_rows_keep_their_columns(spark, odd_docs):
    named = odd_docs.selectExpr("*", "'a' as r_spans", "2 as r_doc", "'b' as r_ends", "3 as r_ids", "4 as r_key", "5 as cut_words")
    out = paragraphs.dedupe(named)
    assert out.columns[:len(named.columns)] == named.columns and out.columns[-3:] == ["cut_words_", "cut_passages", "cut_first_ids"]
    rows = out.collect()
    assert len(rows) == named.count() and {r["cut_words_"] for r in rows} == {0}  # (1, text) twice is one document
    assert sorted((r["doc_id"] or -1, r["text"] or "-") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "-") for r in named.collect())
    copies = paragraphs.dedupe(named.union(named.withColumn("doc_id", F.col("doc_id") + 100)))
    assert {r["doc_id"] for r in copies.where("cut_words_ > 0").collect()} == {101, 105}
