"""Kneser-Ney model checks: probabilities normalise for every context, and
Spark scoring equals a brute-force ARPA back-off scorer."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from varietylens.operators import lm as L

CORPUS = ["a b c a b", "b c a", "a a b c c", "c b a b", "a b c"]


def brute_kn(sents, N):
    """Plain-Python interpolated modified KN (same published formulas)."""
    counts = defaultdict(int)
    for s in sents:
        t = ["<s>"] + s.split() + ["</s>"]
        for e in range(1, len(t)):
            for n in range(1, min(N, e + 1) + 1):
                counts[tuple(t[e - n + 1:e + 1])] += 1
    adj = {}
    for g, c in counts.items():
        if len(g) == N or g[0] == "<s>":
            adj[g] = c
        else:
            adj[g] = sum(1 for h in counts if len(h) == len(g) + 1 and h[1:] == g)
    disc = {}
    for n in range(1, N + 1):
        t = [sum(1 for g, a in adj.items() if len(g) == n and a == k) for k in (1, 2, 3, 4)]
        try:
            y = t[0] / (t[0] + 2 * t[1])
            d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
            if not all(0 <= d[k - 1] <= k for k in (1, 2, 3)):
                raise ZeroDivisionError
        except ZeroDivisionError:
            d = list(L.FALLBACK)
        disc[n] = d
    D = lambda n, a: disc[n][min(a, 3) - 1] if a > 0 else 0.0
    den, mass = defaultdict(float), defaultdict(float)
    for g, a in adj.items():
        den[g[:-1]] += a
        mass[g[:-1]] += D(len(g), a)
    bo = {h: mass[h] / den[h] for h in den}
    V = sum(1 for g in counts if len(g) == 1) + 1
    p = {}
    for n in range(1, N + 1):
        for g, a in adj.items():
            if len(g) != n:
                continue
            u = (a - D(n, a)) / den[g[:-1]]
            lower = 1.0 / V if n == 1 else p[g[1:]]
            p[g] = u + bo[g[:-1]] * lower
    return p, bo, V


def brute_score(p, bo, V, sent, N):
    t = ["<s>"] + sent.split() + ["</s>"]
    total = 0.0
    punk = bo[()] / V
    for i in range(1, len(t)):
        L_ = min(N - 1, i)
        s = None
        for n in range(L_ + 1, 0, -1):
            g = tuple(t[i - n + 1:i + 1])
            if g in p:
                s = math.log10(p[g])
                m = n
                break
        if s is None:
            s, m = math.log10(punk), 1
        for j in range(m, L_ + 1):
            ctx = tuple(t[i - j:i])
            if ctx in bo:
                s += math.log10(bo[ctx])
        total += s
    return total


def _sents(spark):
    rows = [("word", "x", s.split()) for s in CORPUS] + [("word", "y", s.split()[::-1]) for s in CORPUS]
    return spark.createDataFrame(rows, "unit string, label string, toks array<string>")


def test_probabilities_match_brute_force_and_normalise(spark):
    N = 3
    probs, backoffs, unk, _ = L.estimate(_sents(spark), N, materialize_tables=False)
    p, bo, V = brute_kn(CORPUS, N)
    got = {tuple(r["gram"].split(" ")): 10 ** r["logp"]
           for r in probs.where("label = 'x'").collect()}
    assert set(got) == set(p)
    for g in p:
        assert abs(got[g] - p[g]) < 1e-12
    # sum over the vocabulary (incl. </s> and <unk>, excl. <s>) of p(w|h) is 1
    vocab = sorted({g[0] for g in p if len(g) == 1} | {"<unk>"})
    contexts = {g[:-1] for g in p if len(g) > 1}
    for h in contexts:
        def pw(w, h):
            if h + (w,) in p:
                return p[h + (w,)]
            lower = pw(w, h[1:]) if h else (p[(w,)] if (w,) in p else bo[()] / V)
            return bo.get(h, 1.0) * lower if h else lower
        tot = sum(pw(w, h) for w in vocab)
        assert abs(tot - 1.0) < 1e-9, (h, tot)


def test_scoring_matches_brute_force(spark):
    N = 3
    m = L.fit_lm(_sents(spark), N, materialize_tables=False)
    p, bo, V = brute_kn(CORPUS, N)
    tests = ["a b c", "c c c a", "a z b", "z", "b a b c a b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(tests)], "id long, t string")
    sc = L.score(m, df, ["id"], "word", L.unit_tokens(F.col("t"), "word"))
    got = {r["id"]: r["scores"][m.labels.index("x")] for r in sc.collect()}
    for i, s in enumerate(tests):
        assert abs(got[i] - brute_score(p, bo, V, s, N)) < 1e-9, (s, got[i])


def test_char_unit_scoring_matches_brute_force(spark):
    N = 3
    texts = ["ab ba", "abc", "b a c", "aab"]
    chars = [" ".join(t.replace(" ", "X")) for t in texts]      # the char stream
    rows = [("char", "x", list(t.replace(" ", "X"))) for t in texts]
    m = L.fit_lm(spark.createDataFrame(rows, "unit string, label string, toks array<string>"), N,
                 materialize_tables=False)
    p, bo, V = brute_kn(chars, N)
    tests = ["ab", "ca b", "zz a"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(tests)], "id long, t string")
    sc = L.score(m, df, ["id"], "char", L.unit_tokens(F.col("t"), "char"))
    got = {r["id"]: r["scores"][0] for r in sc.collect()}
    for i, s in enumerate(tests):
        assert abs(got[i] - brute_score(p, bo, V, " ".join(s.replace(" ", "X")), N)) < 1e-9


def test_sparse_contributions_match_brute_force(spark):
    """Some grams are known to one label, some to both."""
    N = 3
    m = L.fit_lm(_sents(spark), N, materialize_tables=False)
    assert {len(r["idx"]) for r in m.contributions().collect()} == {1, 2}
    p, bo, V = brute_kn(CORPUS, N)
    tests = ["a b c", "c c c a", "a z b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(tests)], "id long, t string")
    sc = L.score(m, df, ["id"], "word", L.unit_tokens(F.col("t"), "word"))
    got = {r["id"]: r["scores"][m.labels.index("x")] for r in sc.collect()}
    for i, s in enumerate(tests):
        assert abs(got[i] - brute_score(p, bo, V, s, N)) < 1e-9


def test_units_apart_match_brute_force(spark):
    """Written tables, two units: contributions of one unit alone, order by order."""
    N = 4
    sents = _sents(spark).unionByName(_sents(spark).withColumn("unit", F.lit("char")))
    m = L.fit_lm(sents, N)
    p, bo, V = brute_kn(CORPUS, N)
    for unit in ("word", "char"):
        got = {tuple(r["gram"].split(" ")): r for r in m.probs.where((F.col("label") == "x") & (F.col("unit") == unit)).collect()}
        assert set(got) == set(p)
        for g, r in got.items():
            assert abs(10 ** r["logp"] - p[g]) < 1e-12
            assert len(g) == 1 or abs(10 ** r["logp_suffix"] - p[g[1:]]) < 1e-12
        assert {r["unit"] for r in m.contributions(unit).select("unit").distinct().collect()} == {unit}
    tests = ["a b c", "c c c a", "a z b", "z", "b a b c a b"]
    df = spark.createDataFrame(list(enumerate(tests)), "id long, t string")
    sc = L.score(m, df, ["id"], "word", L.unit_tokens(F.col("t"), "word"))
    got = {r["id"]: r["scores"][m.labels.index("x")] for r in sc.collect()}
    for i, s in enumerate(tests):
        assert abs(got[i] - brute_score(p, bo, V, s, N)) < 1e-9


def test_lines_of_common_length_share_a_block(spark):
    rows = spark.createDataFrame([(i, ["a"] * n) for i, n in enumerate([400, 2000, 30, 3000, 900])],
                                 "id long, _toks array<string>").coalesce(1)
    got = {r["id"]: r["_block"] for r in L.sequence_blocks(rows, 80).collect()}
    assert got[0] == got[1] == got[2] == got[4] != got[3]


def test_grams_lie_with_their_last_but_one_token(spark):
    """Placed where they are counted: a gram, its suffix and the grams of its context together."""
    rows = [("word", lab, t.split()) for lab, t in (("x", "a b c a b d"), ("y", "a b c"), (None, "b b"), ("x", ""))]
    got = L._batch_counts(spark.createDataFrame(rows, "unit string, label string, toks array<string>"), 3, place=True).collect()
    places = {}
    for r in got:
        toks = r["gram"].split(" ")
        places.setdefault((r["unit"], r["label"], toks[max(r["n"] - 2, 0)]), set()).add(r["_k"])
    assert all(len(p) == 1 for p in places.values())
    assert len({min(p) for p in places.values()}) == len(places)
