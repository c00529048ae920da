"""Operators of the training-data subpackage against brute force, and on odd
rows: nulls, empty and long texts, repeated rows, empty tables, clashing names."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varietylens.llm import (embeddings, langid, mixing, packing, paragraphs, queries, sharding, simhash, toxicity,
                             warc, winnowing)
from varietylens.llm.common import TokenRows, components, materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components_are_smallest_reachable(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x and x in {y for e in edges for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(scale=0.12, size=8)).tolist(), i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 8, 0), (303, [float("nan")] + [1.0] * 7, 1),
             (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [None, 1.0], 1), (308, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cell_rows=20, max_pivots=12).collect()}
    ok = [(i, np.array(v), y) for i, v, y in rows if y is not None and v and None not in v
          and np.isfinite(v).all() and np.any(v)]
    near = {i: {j for j, w, z in ok if j != i and y == z and len(v) == len(w)
                and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93} for i, v, y in ok}
    assert sum(map(len, near.values())) > 200 and len(got) == len(rows)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(seen), min(seen) == i)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_budget_is_fitted_exactly():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 6, len(sizes))
        reach = {0}
        for s, c in zip(sizes, counts, strict=True):
            reach = {r + k * int(s) for r in reach for k in range(c + 1)}
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * sizes).sum())
        assert got == max(r for r in reach if r <= budget)
    assert mixing.fit_budget(np.array([0, 3]), np.array([5, 0]), 7).tolist() == [5, 0]


def test_budget_of_long_documents_is_fitted():
    assert mixing.fit_budget([45_000, 55_000, 60_000], [1, 1, 1], 100_000).tolist() == [1, 1, 0]
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(rng.integers(9_000, 60_000, 7))
        reach = {0}
        for s in sizes.tolist():
            reach |= {r + s for r in reach}
        budget = int(rng.integers(0, sizes.sum() + 1))
        take = mixing.fit_budget(sizes, np.ones(len(sizes), int), budget)
        assert (take <= 1).all() and int((take * sizes).sum()) == max(r for r in reach if r <= budget)


def test_mix_reaches_targets(spark, docs, odd_docs):
    got = mixing.mix(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").toPandas()
    by = got.assign(taken=got.mix_size * got.mix_copies).groupby("source").agg(
        t=("mix_target", "first"), s=("mix_source_size", "first"), k=("taken", "sum"))
    assert (by.t <= 2 * by.s).all() and abs(by.t.sum() - 1.5 * by.s.sum()) < 1e-6 * by.s.sum()
    for name, own in by.iterrows():  # as near as any choice of documents
        passes, reach = int(own.t // own.s), {0}
        for size in got.mix_size[got.source == name]:
            reach |= {r + int(size) for r in reach}
        assert own.k == passes * own.s + max(r for r in reach if r <= own.t - passes * own.s)
    assert set(got.mix_copies) <= {0, 1, 2}
    odd = mixing.mix(odd_docs)
    assert odd.count() == odd_docs.count() and mixing.mix(odd_docs.limit(0)).count() == 0
    again = mixing.mix(docs.repartition(3)).select("doc_id", "mix_copies").toPandas().sort_values("doc_id")
    assert (again.mix_copies.values == got.sort_values("doc_id").mix_copies.values).all()


def test_paragraphs_cut_what_repeats(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    text = lambda n: [word() for _ in range(n)]
    passage, line = text(60), text(12)
    near = passage.copy()
    rows, planted = [], {3: passage, 7: passage, 11: passage, 12: near}
    for i in range(20):
        w = text(150)
        if i in planted:
            at = int(rng.integers(20, 120))
            w[at:at] = planted[i]
        if i % 2:
            w[5:5] = line
        rows.append((i, " ".join(w)))
    rows += [(20, rows[15][1]), (21, None), (22, ""), (23, "four words are few"), (23, "four words are few"), (None, rows[15][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = paragraphs.dedupe(df)
    assert got.columns[:3] == df.columns
    got = [r for r in got.collect()]
    assert len(got) == len(rows)
    cut = {r["doc_id"]: r for r in got if r["cut_words"]}
    assert set(cut) == {7, 11, 12, 20, None} and cut[7]["cut_first_ids"] == [3]
    assert all(cut[i]["cut_words"] > 30 for i in (7, 11, 12)) and cut[20]["cut_words"] > 100
    clean = dict(rows)
    assert all(r["text"] == clean[r["doc_id"]] for r in got if not r["cut_words"])
    assert paragraphs.dedupe(df.limit(0)).count() == 0


def test_planted_passages_are_cut_almost_whole(spark):
    rng = np.random.default_rng(51)
    text = lambda n: ["".join(c) for c in rng.choice(list("abcdefghijklmnop"), (n, 6))]
    rows, planted = [], 60
    for i in range(planted):  # the passage of 51 words stands in document i and in document 100 + i
        passage = text(51)
        for doc in (i, 100 + i):
            w = text(120)
            at = int(rng.integers(1, 119))
            rows.append((doc, " ".join([*w[:at], *passage, *w[at:]])))
    # two keepers: 30 words of the passage of 300 also stand in 201, all of it in 202
    passage = text(60)
    rows += [(201, " ".join([*text(40), *passage[12:42], *text(40)])), (202, " ".join([*text(40), *passage, *text(40)])),
             (300, " ".join([*text(40), *passage, *text(40)]))]
    got = {r["doc_id"]: r for r in paragraphs.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[i]["cut_words"] for i in range(planted))
    # a near paragraph (Jaccard 0.8) may take up to two words more at either end
    cut = [got[100 + i]["cut_words"] for i in range(planted)]
    assert min(cut) >= 51 and max(cut) <= 55 and all(got[100 + i]["cut_passages"] == 1 for i in range(planted)), cut
    assert 60 <= got[300]["cut_words"] <= 64 and not set(passage) & set(got[300]["text"].split())


def test_anchors_are_minima_of_every_window():
    rng = np.random.default_rng(12)
    for n in (1, 2, 11, 12, 13, 300):
        x = rng.integers(0, 40, n).astype(np.uint64)
        width = min(paragraphs.SPAN, n)
        assert paragraphs._anchors(x).tolist() == sorted({i + int(x[i:i + width].argmin()) for i in range(n - width + 1)})


def test_verified_spans_all_links():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 10**9, 20) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(6):
            x = b.copy()
            x[rng.integers(0, 20, rng.integers(0, 4))] = rng.integers(0, 10**9)
            sets.append(np.unique(x.astype(np.uint64)))
    n = len(sets)
    near = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j]))
            >= 0.8 * len(np.union1d(sets[i], sets[j]))]

    def classes(pairs):
        lab = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                lab[i] = lab[j] = min(lab[i], lab[j])
        return lab
    found = paragraphs.verified(sets)
    assert set(map(frozenset, found)) <= set(map(frozenset, near)) and classes(found) == classes(near) and near


def test_shards_move_only_to_the_new_one(spark, odd_docs):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    three = [1.0, 2.0, 1.0]
    got = df.select(sharding.rendezvous([F.col("doc_id")], three).alias("a"),
                    sharding.rendezvous([F.col("doc_id")], [*three, 1.0]).alias("b")).toPandas()
    share = got.a.value_counts(normalize=True)
    assert abs(share[1] - 0.5) < 0.02 and (got.b[got.a != got.b] == 3).all() and abs((got.b == 3).mean() - 0.2) < 0.02
    rows = odd_docs.select("doc_id", "n", sharding.rendezvous([F.col("doc_id")], three).alias("shard"))
    rows = rows.union(rows).union(rows)
    out = sharding.numbered(rows, "shard", ["doc_id"], buckets=4, chunk=2)
    assert out.count() == rows.count()
    for _, g in out.toPandas().groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.numbered(rows.limit(0), "shard", ["doc_id"]).count() == 0


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(800):
        w = [f"{rng.choice(['ka', 'lo', 'mi'])}{rng.integers(0, 400)}tu".replace("0", "o") for _ in range(60)]
        bad = i % 5 == 0
        for _ in range(5 * bad):
            w[rng.integers(0, 60)] = "grimble" if rng.random() < 0.5 else "zorv" + rng.choice(list("abcdefgh")) + "en"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    args = dict(learn=crc % 5 != 0, fold=(crc % 5 - 1).cast("int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, lab, **args).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert {r["score"] for r in toxicity.score(df, lab.limit(0), **args).collect()} == {0.0}
    assert toxicity.score(df.limit(0), lab, **args).count() == 0


def test_winnowing_matches_brute_force(spark, odd_docs):
    def brute(text, k, w):
        pts = winnowing._POINT[winnowing.code_points(text)].tolist()
        if not pts:
            return []
        k = min(k, len(pts))
        grams = np.array([sum(p * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, p in enumerate(pts[i:i + k])) % (1 << 64)
                          for i in range(len(pts) - k + 1)], np.uint64)
        h = (winnowing.mix64(grams) >> np.uint64(32)).tolist()
        w = min(w, len(h))
        return sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)})
    rng = np.random.default_rng(0)
    for k, w in ((5, 4), (16, 48), (7, 9)):
        for n in (0, 1, 4, 16, 60, 300):
            text = "".join(rng.choice(list("abé \U0001F600"), n)) if n else ""
            assert winnowing.winnow(winnowing.code_points(text), k, w)[1].tolist() == brute(text, k, w)
    shared = "the passage that both of the two texts hold, long enough for the guarantee"
    a, b = (set(winnowing.winnow(winnowing.code_points(x + shared + y))[0].tolist()) for x, y in (("ab cd " * 9, "z" * 70), ("q" * 50, " 12 34" * 8)))
    assert a & b
    h, p = winnowing.winnow(winnowing.code_points(shared))
    again = winnowing.read(winnowing.written(h, p))
    assert again[0].tolist() == h.tolist() and again[1].tolist() == p.tolist()
    out = winnowing.fingerprints(odd_docs, parts=3).collect()
    assert len(out) == odd_docs.count()
    first, last = out[0], next(r for r in out if r["doc_id"] == 7)
    assert {r["fingerprint"] for r in out if r["doc_id"] == 1} == {next(r["fingerprint"] for r in out if r["doc_id"] == 1)}
    assert first is not None and last["near_next"] in (0.0, 1.0) and winnowing.fingerprints(odd_docs.limit(0)).count() == 0


def test_next_document_wraps_around(spark):
    rows = [(i, c * 8) for i, c in enumerate("abcde")]
    out = {r["doc_id"]: r["edited_text"] for r in winnowing.fingerprints(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parts=3).collect()}
    assert out == {0: "a" * 6 + "bb", 1: "b" * 6 + "cc", 2: "c" * 6 + "dd", 3: "d" * 6 + "ee", 4: "e" * 6 + "aa"}


def simple_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [sum(xxhash.xxh64_intdigest(g.encode(), seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def test_simhash_groups_match_brute_force(spark, docs, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fps = [simple_simhash(t) for _, t in rows]
    lab = {f: f for f in set(fps)}
    for _ in range(20):
        for f in lab:
            lab[f] = min(lab[g] for g in lab if (f ^ g).bit_count() <= 3)
    ids = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            ids[lab[f]] = min(i, ids.get(lab[f], i))
    want = Counter((i, f, ids.get(lab[f])) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({simple_simhash(r["text"]) for r in odd_docs.collect()})
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_simhash_links_span_all_close_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:  # dense groups and chains
        for _ in range(40):
            fps.add(int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 4), replace=False))))
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.linked(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)

    def classes(pairs):
        lab = {f: f for f in fps}
        while True:
            before = dict(lab)
            for a, b in pairs:
                lab[a] = lab[b] = min(lab[a], lab[b])
            if lab == before:
                return lab
    assert classes(got) == classes([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def test_packing_round_trip(spark, docs, odd_docs):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    both = docs.select("doc_id", "text").union(odd_docs.where("doc_id is not null and doc_id <> 1").selectExpr("doc_id + 100000", "text"))
    cut = packing.pieces(both, path, size=256)
    placed = packing.place(cut, size=256)
    rows = placed.collect()
    for r in both.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x["doc_id"] == r["doc_id"]), key=lambda x: x["start"])
        assert np.concatenate([np.frombuffer(x["ids"], "<u4") for x in own]).tolist() == ids
        assert [x["start"] for x in own] == list(range(0, len(ids), 256)) and {x["doc_tokens"] for x in own} == {len(ids)}
    used = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == used.get(x["sequence_id"], 0)
        used[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(used.values()) <= 256 and sum(used.values()) > 0.95 * 256 * len(used)
    assert packing.place(packing.pieces(docs.limit(0), path)).count() == 0


def test_histogram_packing_uses_every_length():
    rng = np.random.default_rng(6)
    for size in (16, 100):
        counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, size + 1, 30)}
        patterns = packing.pack_histogram(counts, size)
        used = Counter()
        for p, n in patterns:
            assert sum(p) <= size and n > 0
            for x in p:
                used[x] += n
        assert used == Counter(counts)


def test_warc_round_trip_and_lookup(spark):
    long = "x" * 150
    rows = [(i, f"http://h{i % 7}.example.org/p/{i}?q={i}", f"<p>{i}</p>" * 20) for i in range(300)]
    rows += [(1000 + i, "http://Hot.example.org/", long) for i in range(50)] + [
        (2000, None, None), (2001, "", ""), (2002, "not a url\n\t", "short"), (2003, "http://x/é ü", "short"),
        (2004, "http://[bad/", "é" * 60), (2004, "http://[bad/", "é" * 60), (None, "http://n/", long), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(df)
    got = warc.lookup(archive, df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, _, html in rows:
        same = html == long and i != 1000
        want[i, "revisit" if same else "response", 1000 if same else None, "" if same else html or ""] += 1
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in got) == want
    one = warc.lookup(archive, df.where("page_id = 17")).collect()
    assert [bytes(r["payload"]).decode() for r in one] == [rows[17][2]]
    assert warc.lookup(archive, spark.createDataFrame([("http://none/", 1)], "url string, page_id long")).count() == 0
    empty = warc.write(df.limit(0))
    assert warc.lookup(empty, df).count() == 0
    assert warc.url_key("http://www.Example.com:81/A?B=c") == "com,example,www:81)/a?b=c"


def test_language_backoff(spark, odd_docs):
    rows = [("der hund und die katze sind hier", "de"), ("the dog and the cat are here", "en"), (None, "en"), ("x", None)] * 20
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["de", "en"]
    assert model.predict("the dog")[0] == "en" and model.predict("die Katze!")[0] == "de"
    assert model.predict("hundertkatzen")[0] == "de" and model.predict("catdogs")[0] == "en"  # unseen: by grams
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !?") == ("und", 0.0)
    out = langid.predict(odd_docs, model)
    assert out.columns[:-2] == odd_docs.columns and out.count() == odd_docs.count()
    empty = langid.train(odd_docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd_docs, empty).collect()} == {"und"}


def test_language_model_knows_every_counted_word(spark):
    word = lambda i: "".join("abcdefghijklmnop"[i >> s & 15] for s in (16, 12, 8, 4, 0))
    hot = " ".join(map(word, range(60_000)))  # twice each, the words of the other language once
    rare = list(map(word, range(60_000, 60_200)))
    model = langid.train(spark.createDataFrame([(hot, "en"), (hot, "en"), (" ".join(rare + ["zzzzz"] * 119_800), "de")], "text string, lang string"))
    assert {model.predict(w)[0] for w in rare} == {"de"}
    assert {model.predict(word(i))[0] for i in range(0, 60_000, 999)} == {"en"}
    # a word never met: mean of its longest grams that were
    got = model.unseen(["abcz"])[0]
    found = [i for g in langid.grams("abcz", 4) if (i := int(model.grams.at([g])[0])) >= 0]
    assert found and np.allclose(got, model.grams.logs[found].mean(0))


def test_token_rows_are_bounded():
    rows = TokenRows(1, lambda t: [float(t)], most=10)
    for i in range(50):
        tokens = [str(x) for x in range(i, i + 4)]
        assert rows(tokens)[:, 0].tolist() == [float(t) for t in tokens] and len(rows.index) <= 10
    assert len(rows([str(x) for x in range(40)])) == 40


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() > 0, name
        assert docs.columns == names or k == len(corpus_pipeline.STAGES) - 1
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF))
    assert empty.count() == 0


def test_token_rows_match_plain_reading():
    """Column kernels against one text and one token at a time."""
    import numpy as np
    import pyarrow as pa

    from varietylens.llm import packing, toxicity
    from varietylens.llm.queries import tokenizer_path

    texts = ["", None, " ", "you IDIOT, you!!", "  a  b ", "id1ot idiooot? far from all of it you", "idiot\n\nx y.z", "IDIOT"]
    scorer = toxicity.Scorer({"idiot": 4.0, "idio~": 3.0, "far": 2.6})
    got = scorer.features(pa.array(texts, pa.string()))
    alone = np.concatenate([toxicity.Scorer(scorer.lexicon).features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(got, alone)  # neighbours in a batch have no influence
    col = dict(zip(toxicity.FEATURES, got.T, strict=True))
    assert not got[:3].any()
    assert col["word_1"].tolist() == [0, 0, 0, 1 / 3, 0, 0, 1 / 4, 1]
    assert col["second_person"][3] == 2 / 3 and col["aimed"].tolist() == [0, 0, 0, 1 / 3, 0, 0, 0, 0]
    assert col["capitals"][3] == 5 / 16 and col["shouted"][7] == 1 and col["single"][4] == 1
    assert col["inside"][5] > 0 and col["repeated"][5] > 0 and col["exclaimed"][3] == 2 / 3

    odd = [t or "" for t in texts] + ["a  b", "\n\nx y", "<|endoftext|> hi", "don't stop.\tNow .5 5.", "tail "]
    enc = packing.Encoder(tokenizer_path(), cache=4)  # generations end within the batch
    assert list(enc.encode(pa.array(odd))) == [enc.whole(t) for t in odd]
    assert list(enc.encode(pa.array(odd).slice(5))) == [enc.whole(t) for t in odd[5:]]
    assert list(enc.encode(pa.array([], pa.string()))) == []
    for t in ("a b c", "a b c d e", "c f g h i j", "a f"):  # known and new pieces when a generation ends
        assert list(enc.encode(pa.array([t]))) == [enc.whole(t)]
