"""n-gram counts cover every line of every document."""

from collections import Counter

import __spark_entry__ as E


def test_ngram_counts_cover_every_line(spark, tmp_path):
    """Copies and lines outside the training split count too."""
    texts = [f"ab c{i}\n\nab ab" for i in range(8)] + ["ab c0\n\nab ab", None, " "]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [line for t in texts if t for line in t.split("\n") if line.strip()]
    for unit, tokens in (("word", str.split), ("char", lambda t: list(t.replace(" ", "X")))):
        want = Counter()
        for line in lines:
            toks = ["<s>", *tokens(line), "</s>"]
            for n in (1, 2, 3):
                for end in range(max(n, 2), len(toks) + 1):
                    want["web-en-germanic", n, " ".join(toks[end - n:end])] += 1
        got = {(r["label"], r["n"], r["gram"]): r["c"] for r in E.queries()[f"ngram_counts_{unit}"](spark, str(tmp_path)).collect()}
        assert got == want
