"""Every pipeline stage against a plain version on the smallest tables: what
it keeps, what it takes away, and that clean documents stay as they are."""
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from varietylens.llm import langid, packing, queries
from varietylens.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before each stage and after the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "a", 0), (900_002, "12 !?", "en", "a", 5)], docs.schema)
    out = [materialize(docs.unionByName(odd))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_language_id_rejects_what_the_model_rejects(steps):
    model = langid.train(steps[0])
    kept = [r for r in plain(steps[0]) if (p := model.predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    assert Counter(plain(steps[1])) == Counter(kept) and 150 < len(kept) < len(plain(steps[0]))


def test_simhash_keeps_the_first_of_each_group(steps):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    rows = sorted(plain(steps[1]))
    fp = [fingerprint(r[1]) for r in rows]
    lab = list(range(len(rows)))
    for _ in rows:
        before = lab.copy()
        for i in range(len(rows)):
            lab[i] = min(lab[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 3)
        if lab == before:
            break
    assert Counter(plain(steps[2])) == Counter(rows[i] for i in sorted(set(lab)))


def test_substring_stage_cuts_only_what_an_earlier_document_holds(steps):
    before, after = {r[0]: r for r in plain(steps[2])}, {r[0]: r for r in plain(steps[3])}
    texts = {i: r[1].split() for i, r in before.items()}
    grams = {}  # first document of every five words
    for i in sorted(texts):
        for k in range(len(texts[i]) - 4):
            grams.setdefault(tuple(texts[i][k:k + 5]), i)
    cut = 0
    for i, r in before.items():
        if i not in after or after[i][1] != r[1]:
            own = after[i][1].split() if i in after else []
            gone = Counter(texts[i]) - Counter(own)
            earlier = Counter(w for k in range(len(texts[i]) - 4) if grams[tuple(texts[i][k:k + 5])] < i for w in set(texts[i][k:k + 5]))
            assert sum(w not in earlier for w in gone.elements()) <= 4  # near passages: a word or two at either end
            assert i not in after or after[i][4] == len(after[i][1])
            cut += 1
        elif len(texts[i]) < 50:
            continue
        else:  # kept whole: no 50 words in a row of it stand in an earlier document
            run = 0
            for k in range(len(texts[i]) - 4):
                run = run + 1 if grams[tuple(texts[i][k:k + 5])] < i else 0
                if run >= 46:
                    span = texts[i][k - 45:k + 5]
                    assert not any(" ".join(span) in " ".join(texts[j]) for j in texts if j < i)
    assert cut and set(after) <= set(before)


def test_mixing_and_packing_account_for_every_word_and_token(steps):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, mixed = plain(steps[3]), Counter(plain(steps[4]))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    taken = Counter()
    for r, n in mixed.items():
        assert n <= 2 and r in set(rows)
        taken[r[3]] += n * words(r[1])
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    for s in order:  # what is missed is less than the shortest document that could be taken once more
        base = min(n for n in (mixed.get(r, 0) for r in rows if r[3] == s))
        spare = min((words(r[1]) for r in rows if r[3] == s and mixed.get(r, 0) == base), default=0)
        assert -1e-6 <= target[s] - taken[s] < max(1, spare) + 1, (s, target[s], taken[s], spare)
    enc = packing.Encoder(queries.tokenizer_path())
    want = Counter()
    for r, n in mixed.items():
        want[r[0]] += n * (len(enc.whole(r[1] or "")) // 4 + 1)
    got = Counter()
    for r in steps[5].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
