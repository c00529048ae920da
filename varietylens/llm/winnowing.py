"""Document fingerprints by winnowing.

Hashes of all character k-grams roll over the text; from every window of
``window`` consecutive hashes the smallest is chosen, the rightmost of equal
ones. Positions are kept: any passage of ``window + k - 1`` characters that
two texts share leaves a common chosen hash, at the passage's place in both.

A text shorter than k is hashed as one gram; a shorter list of grams than the
window is one window. Null and empty texts have no entries. Likeness is the
Jaccard measure of the two sets of hashes, 1 for two empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mix64, partitions

K, WINDOW = 16, 48
U64 = np.uint64
_POINT = mix64(np.arange(0x110000, dtype=U64) + U64(0x5851F42D4C957F2D))  # a word per code point


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as uint32, positions) of the chosen k-grams."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h, have, power = _POINT[points], 1, U64(0x9E3779B97F4A7C15)
    k = min(k, n)
    whole, done, factor = None, 0, U64(1)
    # k-gram hashes by doubling: h[i] covers `have` characters
    with np.errstate(over="ignore"):
        while True:
            if k & have:
                part = h[done:] if whole is not None else h
                if whole is None:
                    whole, factor = part, power
                else:
                    m = min(len(whole), len(part))
                    whole, factor = whole[:m] + factor * part[:m], factor * power
                done += have
            if done >= k:
                break
            h = h[:-have] + power * h[have:]
            power, have = power * power, have * 2
        whole = mix64(whole[:n - k + 1])
    # smallest hash first, among equal ones the rightmost position
    pos = np.arange(len(whole), dtype=U64)
    packed = (whole >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - pos)
    least = _least(packed, min(window, len(packed)))
    least = least[np.append(True, least[1:] != least[:-1])]
    return (least >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hex digits per hash and the step from the position before it."""
    if not len(hashes):
        return ""
    row = np.empty(len(hashes), np.dtype([("hash", ">u4"), ("step", ">u2")]))
    row["hash"], row["step"] = hashes, np.diff(positions, prepend=0)
    return row.tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a written fingerprint."""
    row = np.frombuffer(bytes.fromhex(fingerprint), np.dtype([("hash", ">u4"), ("step", ">u2")]))
    return row["hash"].astype(np.uint32), np.cumsum(row["step"].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard measure of two arrays of distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of another text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def with_next(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """(part, doc_id, text, guest): parts are ranges of doc_id, and each part
    also holds the first row of the next one (the last: of the first) as a
    guest, sorted last. Texts move once. ``parts`` - 1 bounds are collected."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    quantiles = [i / parts for i in range(1, parts)]
    bounds = rows.select(F.percentile_approx("doc_id", quantiles, 10_000).alias("q")).first()["q"] if quantiles else None
    bounds = sorted(set(bounds or []))
    # ids after as many bounds; null ids (after none) are in the first part
    after = F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id")) if bounds else None
    rows = rows.withColumn("part", F.size(after) if bounds else F.lit(0))
    # null ids come first; the first row of a part is its smallest (id, text)
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("first"))
    heads = [(r["part"], r["first"]["doc_id"], r["first"]["h"]) for r in heads.orderBy("part").collect()]
    spark = docs.sparkSession
    guests = spark.createDataFrame(
        [(heads[i - 1][0], d, h) for i, (_, d, h) in enumerate(heads)], "g_part int, g_id long, g_hash long")
    guests = (rows.join(F.broadcast(guests), rows["doc_id"].eqNullSafe(guests["g_id"])
                        & (F.xxhash64("text") == guests["g_hash"]))
                  .dropDuplicates(["g_part"])
                  .select("doc_id", "text", F.col("g_part").alias("part"), F.lit(True).alias("guest")))
    everything = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return (everything.repartition(max(1, len(heads)), "part")
                      .withColumn("h", F.xxhash64("text")).sortWithinPartitions("part", "guest", "doc_id", "h")
                      .select("part", "doc_id", "text", "guest"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                 window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint; edited text and its fingerprint;
    likeness to the edited text and to the next document's text. "Next" is by
    (doc_id, hash of the text), null ids first, the last row's is the first."""
    ordered = with_next(docs, doc_id, text, parts or partitions(docs.sparkSession))
    names = ["doc_id", "n_chars", "fingerprint", "edited_text", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        before = None  # part, id, text, hashes, positions
        for batch in batches:
            rows = []
            for part, doc, body, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = winnow(code_points(body), k, window)
                now = (part, doc, body, *own, np.unique(own[0]))
                if before is not None and before[0] == part:
                    other = edited(before[2], body)
                    cut = winnow(code_points(other), k, window)
                    rows.append((before[1], len(before[2]), written(*before[3:5]), other, written(*cut),
                                 likeness(before[5], np.unique(cut[0])), likeness(before[5], now[5])))
                before = None if guest else now
                if len(rows) >= 2000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)
    return in_arrow(ordered, run, "doc_id long, n_chars long, fingerprint string, edited_text string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list, names: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
