"""Registered queries on hand-made tables against plain versions: rows that
went wrong before, null and repeated ids, columns of clashing names."""
import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from varietylens.llm import mixing, packing, queries, sharding


def test_embedding_rows_with_null_components(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, None, 2.0], 0), (3, [None, 1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], None),
            (6, [2.0, 4.1], 0), (7, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (8, [-1.0, 2.0], 0), (9, [0.0, 0.0], 0), (1, [1.0, 2.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as n_links") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Counter(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept"))
                  for r in queries.QUERIES["op1_embedding_neardup"](spark, str(tmp_path)).collect())
    want = Counter()
    for k, (i, v, y) in enumerate(rows):
        ok = lambda x: None not in x and any(x)
        near = [j for m, (j, w, z) in enumerate(rows) if m != k and y is not None and y == z and ok(v) and ok(w) and len(v) == len(w)
                and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        head = min([x for x in [i, *near] if x is not None], default=None)  # one step reaches all here
        want[i, len(near), head, i == head] += 1
    assert got == want


def test_pages_with_equal_keys_and_two_payloads(spark, tmp_path):
    a, b = "a" * 150, "b" * 180
    rows = [(1, "http://h/X", "small"), (1, "http://h/x", b), (1, "http://h/y", a), (2, "http://h/2", a), (3, "http://h/3", b), (4, None, None),
            (5, "http://h/5", "small"), (6, "http://h/6", "é" * 50), (7, "http://h/7", "é" * 50), (None, "http://h/8", "é" * 50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in queries.QUERIES["op9_warc"](spark, str(tmp_path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        head = min((j for j, _, h in rows if h == html and j is not None), default=None)
        other = len(raw) >= 100 and i != head
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", head if other else None] += 1
    assert got == want


def test_pieces_of_null_ids_and_repeated_rows(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op8_packing"](spark, str(tmp_path)).collect()
    enc = packing.Encoder(queries.tokenizer_path())
    want = Counter()
    for d in odd_docs.select("doc_id", "text").collect():
        ids = enc.whole(d["text"] or "") + bytes(4)
        for s in range(0, len(ids) // 4, 1024):
            part = ids[4 * s:4 * (s + 1024)]
            want[d["doc_id"], s, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024


def test_ranks_of_many_groups_fill_every_slot(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 9, 3000))], "doc_id long, start long, length long")
    out = packing.place(rows.withColumn("offset", F.lit(1)).withColumn("p_rank", F.lit(2)), size=8, group=50)
    assert out.columns == ["doc_id", "start", "length", "offset", "p_rank", "sequence_id", "offset_"]
    used = Counter()
    for r in sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset_"])):
        assert r["offset_"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) == 8 and sum(used.values()) == rows.agg(F.sum("length")).first()[0]


def test_added_columns_give_way(spark, odd_docs):
    named = odd_docs.selectExpr("*", "1 as mix_size", "2 as MIX_COPIES", "3 as q_need", "4 as mix_target", "5 as mix_source_size")
    out = mixing.mix(named)
    assert out.columns == [*named.columns, "mix_size_", "mix_source_size_", "mix_target_", "mix_copies_"]
    assert out.count() == named.count()
    shards = sharding.numbered(odd_docs.selectExpr("doc_id", "0 as slot", "1 as shard", "2 as base"), "shard", ["doc_id"])
    assert shards.columns[-1] == "slot_" and sorted(r["slot_"] for r in shards.collect()) == list(range(odd_docs.count()))
