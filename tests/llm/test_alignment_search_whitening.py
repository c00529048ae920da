"""Token alignment, one-bit search and whitening against brute force, and on
odd rows: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing names."""
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from varietylens.llm import alignment, onebit, queries, whitening

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# --- alignment ---------------------------------------------------------------

def plain_alignment(pair, text):
    """(A ids, B ids, groups, links) read token by token; None: no tokens."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    parts = [[pair.bytes[0][i].as_py() for i in a], [pair.bytes[1][i].as_py() for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        ni, nj = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    begins = [[0, *e[:-1]] for e in ends]
    links = [(x, y) for x, s, e in zip(a, begins[0], ends[0]) for y, t, f in zip(b, begins[1], ends[1]) if max(s, t) < min(e, f)]
    return a, b, groups, links


TEXTS = [None, "", " ", "a", "a  b", " x", "x ", "▁", "a▁b", "<|endoftext|> hi", "<s> </s> <0x41>", "don't stop.\tNow .5 5.", "\n\nx y",
         "漢字漢字 🙂🙂 é", "same text here", "same text here", "longwordwithoutanyblank" * 40, "tabs\tand\r\nlines here"]


def test_alignment_matches_plain_reading(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("abc dé🙂\n.,'▁ x9"), 40)) for _ in range(60)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "null id here", 1), (3, "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    out = alignment.align(df, A, B)
    pair = alignment.Pair(A, B)
    plain = [(i, plain_alignment(pair, t)) for i, t, _ in rows]
    counts = Counter(x for _, p in plain if p for x in p[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    want = Counter()
    for i, p in plain:
        if p is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        a, b, groups, links = p
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), said] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r[c] for c in names) for r in out.documents.collect()) == want
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in out.counts.collect()} == {
        x: (n, n == best[x[1]]) for x, n in counts.items()}
    none = alignment.align(df.limit(0), A, B)
    assert none.documents.count() == 0 and none.counts.count() == 0
    assert sum(p is None for _, p in plain) > 3


def test_alignment_rows_stay_small_whatever_the_block(monkeypatch):
    """A block's arrays are written as bounded rows, and put together again in order."""
    monkeypatch.setattr(alignment, "CODES", 7)
    monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    texts = ["same words here", "other words here and there", None, "don't stop.\tNow .5 5.", "漢字 é same", "a b c d e f g h i j"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(alignment._block_rows(A, B, False)([batch]))
    assert alignment._PARTS.count(",") + 1 == rows.num_columns
    kinds = rows["kind"].to_pylist()
    sizes = [len(b) // 8 for k, b in zip(kinds, rows["body"].to_pylist()) if k == 0]
    assert len(sizes) > 2 and max(sizes) == 7
    whole, (links, at, often) = alignment.align_block(alignment.Pair(A, B), batch.column(1), False)
    counted = Counter()
    for piece, n in enumerate(often.tolist()):
        for x in links[at[piece]:at[piece + 1]].tolist():
            counted[x] += n
    pairs = pa.Table.from_batches(alignment._pair_rows(rows.filter(pc.equal(rows["kind"], 0)).select(["block", "body", "ends"]).to_batches()))
    assert dict(zip(pairs["pair"].to_pylist(), pairs["n"].to_pylist())) == {x: n for x, n in counted.items() if n}
    n, none = len(pairs), [None] * len(pairs)
    said = [c.split()[0] for c in alignment._PARTS.split(", ")]
    first = pa.table([pairs["block"], pa.array([0] * n, pa.int32()), pa.array(none, pa.int32()), pairs["pair"], pairs["n"], pa.array([True] * n),
                      *[pa.array(none, rows[c].type) for c in said[3:]]], ["block", "kind", "part", "pair", "n", "best", *said[3:]])
    kept = rows.filter(pc.greater(rows["kind"], 0))
    m = [None] * len(kept)
    rest = pa.table([kept["block"], kept["kind"], kept["part"], pa.array(m, pa.int64()), pa.array(m, pa.int64()), pa.array(m, pa.bool_()),
                     *[kept[c] for c in said[3:]]], first.column_names)
    got = pa.Table.from_batches(alignment._document_rows(pa.concat_tables([first, rest]).combine_chunks().to_batches(max_chunksize=5)))
    words = [x.tolist() for x in whole[5]]
    assert got["n_best"].to_pylist() == whole[3].tolist()
    assert got["count_sum"].to_pylist() == [sum(counted[x] for w in ws for x in links[at[w]:at[w + 1]].tolist()) for ws in words]


def test_registered_alignment_digests_groups(spark):
    got = queries.QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 = 1").collect()
    rows = {r["doc_id"]: r for r in got.where("doc_id % 10 = 1").collect()}
    pair = alignment.Pair(A, B)
    for d in docs:
        a, b, groups, links = plain_alignment(pair, d["text"])
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        r = rows[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(links))
        assert r["groups_sha256"] == sha256(said.encode()).hexdigest()


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a_ends, b_ends, a_from, b_from, base = [], [], [0], [0], 0
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 60))
            for ends, start in ((a_ends, a_from), (b_ends, b_from)):
                inner = np.flatnonzero(rng.random(n - 1) < rng.choice([0.05, 0.5, 1])) + 1
                ends += [base + int(x) for x in inner] + [base + n]
                start.append(len(ends))
            base += n
        a, b = np.array(a_ends), np.array(b_ends)
        assert alignment.cuts(a, b, np.array(a_from), np.array(b_from)).tolist() == np.isin(a, b).tolist()


# --- one-bit search ------------------------------------------------------------

def exact_search(rows, query, k):
    """Brute force; rows are (vec_id, vector). A power of two keeps squares in
    range and changes no cosine."""
    ok = [(n, i, np.ldexp(np.array(v, np.float64), -np.frexp(np.abs(v).max())[1])) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for n, i, v in ok:
        if i is not None and query(i):
            near = sorted((-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j is None, j if j is not None else 0)
                          for m, j, w in ok if m != n and len(w) == len(v))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(near[:k])]
    return out


def test_search_on_odd_rows_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[10][1]) for i in range(8)] + [(20, rows[10][1]), (None, rows[10][1]), (10, rows[10][1])]
    rows += [(200, None), (210, []), (220, [0.0] * 6), (230, [float("nan")] + [1.0] * 5), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (250, [float("inf")] + [1.0] * 5), (260, [1e200] * 6), (270, [1e-200, 2e-200, 5e-200, 1e-200, 0.0, 3e-200]), (280, [1.0, 2.0]), (285, [2.0, 4.5]), (290, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("cid", F.lit(2))
    got = onebit.search(df.repartition(3), F.col("vec_id") % 10 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, round(r[3], 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, exact_search(rows, lambda i: i % 10 == 0, 5)))
    assert onebit.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert onebit.search(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)) + rng.normal(size=64) * 0.5
    x[3000:3400] = x[0] + rng.normal(size=(400, 64)) * 0.05  # a dense group
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = onebit.search(df, F.col("vec_id") % 100 == 0, k=5).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 6000, 100):
        s = u @ u[q]
        s[q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(own.score) <= 0).all()
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hit += len(set(np.argsort(-s)[:5]) & set(own.vec_id))
    assert hit >= 0.98 * 5 * 60


def test_codes_estimate_within_their_bound():
    rng = np.random.default_rng(6)
    turn = onebit.rotation(64, 256, 1)
    assert np.allclose(turn.T @ turn, np.eye(64))
    o, _ = onebit.unit(rng.normal(size=(2000, 64)))
    q, _ = onebit.unit(rng.normal(size=(50, 64)))
    c = o.mean(0)
    code, r, x, oc = onebit.encode(o, c, turn)
    assert code.shape == (2000, 32)  # packed bits
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    near = ((q - c) @ turn.T / 16) @ signs.T * (r / x) + oc + (q @ c - c @ c)[:, None]
    off = (near - q @ o.T) / (np.linalg.norm(q - c, axis=1)[:, None] * r * np.sqrt(1 / x**2 - 1) / np.sqrt(255))
    assert abs(off.mean()) < 0.02 and off.std() < 1.05 and (np.abs(off) > onebit.BOUND).mean() < 0.004


# --- whitening -----------------------------------------------------------------

def plain_whitening(x, k):
    s, n = x.sum(0), len(x)
    t = n * x - s
    c = t / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return (t.astype(object) ** 2).sum(1), c @ vectors / np.sqrt(values), values / (np.trace(c.T @ c) / n)


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 12)) * np.exp(-np.arange(12) / 4) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, r.tolist(), 0) for i, r in enumerate(v)]
    odd = [(None, v[0].tolist(), 1), (0, v[0].tolist(), 2), (-1, None, 0), (-2, [None] + [1.0] * 11, 0), (-3, [float("nan")] * 12, 0),
           (-4, [float("-inf")] + [1.0] * 11, 0), (-5, [], 0), (-6, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, whitened int").repartition(3)
    used = [r for r in rows + odd if r[1] and len(r[1]) == 12 and None not in r[1] and np.isfinite(r[1]).all()]
    x = np.floor(1024 * np.array([r[1] for r in used])).astype(np.int64) + 100_000
    deviation, whitened, explained = plain_whitening(x, 8)
    model = whitening.fit(df)
    assert model.n == len(used) and model.sums == x.sum(0).tolist()
    assert np.allclose(model.eigenvalues / model.trace, explained, rtol=1e-12) and model.identity_error < 1e-12
    out = whitening.transform(df, model)
    assert out.columns == [*df.columns, "whitened_", "deviation"] and out.count() == df.count()
    want = {(i, tag): (d, w) for (i, _, tag), d, w in zip(used, deviation, whitened, strict=True)}
    signs = None
    for r in out.collect():
        if r["whitened_"] is None:
            assert r["vec_id"] in range(-6, 0) and r["deviation"] is None
            continue
        d, w = want[r["vec_id"], r["whitened"]]
        got = np.array(r["whitened_"])
        signs = np.sign(got * w) if signs is None else signs
        assert int(r["deviation"]) == d and np.allclose(got * signs, w, rtol=0, atol=1e-10)
    empty = whitening.fit(df.limit(0))
    assert empty.n == 0 and [r["whitened_"] for r in whitening.transform(df, empty).collect()] == [None] * df.count()
    alone = whitening.fit(df.where("vec_id = 5"))
    assert alone.n == 1 and len(alone.eigenvalues) == 0


def dense(a):
    return lambda w, before: (float((a @ w) @ (a @ w)), np.array([(a @ x) @ (a @ w) for x in before]), a.T @ (a @ w))


@pytest.mark.parametrize("kind", ["plain", "rank", "few", "equal", "pairs", "early"])
def test_leading_values_of_odd_matrices(kind):
    rng = np.random.default_rng(8)
    a = {"plain": rng.normal(size=(200, 30)), "rank": rng.normal(size=(60, 3)) @ rng.normal(size=(3, 20)), "few": rng.normal(size=(4, 20)),
         "equal": np.vstack([np.eye(12), -np.eye(12)]), "pairs": np.diag([5, 5, 5, 3, 3, 3, 3, 3, 2, 2, 1, 1.0]),
         "early": rng.normal(size=(800, 120)) * np.exp(-np.arange(120) / 5)}[kind]
    values, vectors, steps = whitening.leading(dense(a), a.shape[1], 8, np.linalg.norm(a))
    want = np.linalg.svd(a)[1][:8]
    want = want[want > 1e-9 * want[0]]
    assert np.allclose(values, want, rtol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(len(want)), atol=1e-12)
    assert all(np.linalg.norm(a.T @ (a @ v) - s * s * v) < 1e-11 * want[0] ** 2 for s, v in zip(values, vectors))
    assert kind != "early" or steps < 100


def test_whitening_sums_stay_exact():
    x = np.array([[2**43, -(2**40)], [5, 7]], np.int64)
    assert (whitening._centred(x, 10**9, [2**70, 3]) == x.astype(object) * 10**9 - np.array([2**70, 3], object)).all()


def test_registered_queries_have_contract_columns(spark):
    got = queries.QUERIES["op13_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    p = got.toPandas()
    assert len(p) == 8 * len(rows) and set(p.n) == {len(rows)} and (p.identity_error < 1e-10).all()
    assert set(p.component) == set(range(1, 9)) and p.explained.nunique() == 8
    near = queries.QUERIES["op12_onebit_search"](spark, SF).toPandas()
    want = exact_search([(r["vec_id"], r["embedding"]) for r in rows], lambda i: i % 50 == 0, 5)
    found = set(zip(near.query_id, near["rank"], near.vec_id))
    assert len(near) == len(want) and len(found & {x[:3] for x in want}) >= 0.95 * len(want)
