"""Rendezvous (highest-random-weight) sharding, DataFrame functions only.

Every (key, shard) pair gets a pseudo-random score and the shard of smallest
``-ln(u) / weight`` takes the row. The shard depends on the key and the shard
list alone, a shard's share follows its weight, and a new shard takes rows
only into itself: the scores of the old ones don't change.

Null keys are one key like any other; equal keys share a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh


def _score(key: Sequence[Column], shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """Shard 0 .. len(weights)-1 of a key; a weight of 0 takes nothing."""
    scores = [_score(key, s, w) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a positive weight")
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def numbered(rows: DataFrame, shard: str, order: Sequence[str], buckets: int = 1024,
             chunk: int = 100_000) -> DataFrame:
    """``rows`` with ``slot`` as last column (a longer name if there is one): a
    gapless number from 0 within each shard; an empty table has none.

    Equal rows are interchangeable, so they are counted first (combined
    before the shuffle), the counts become slot ranges, and the ranges are
    written out again: a row that repeats a billion times is never in one
    group. Slots follow (bucket of ``order``, ``order``); only a bucket's
    distinct rows are sorted together, and bucket offsets are one row per
    (shard, bucket), which is bounded by ``buckets`` times the shards."""
    names = rows.columns
    n, bucket, part = (fresh(rows, c) for c in ("n", "bucket", "part"))
    start, base, slot = (fresh(rows, c) for c in ("start", "base", "slot"))
    classes = (rows.groupBy(*names).agg(F.count("*").alias(n))
                   .withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets))))
    inside = Window.partitionBy(shard, bucket).orderBy(*order, *[c for c in names if c not in order])
    classes = classes.withColumn(start, F.sum(n).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))
    totals = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets))) \
        .groupBy(shard, bucket).agg(F.count("*").alias(n))
    offsets = totals.select(shard, bucket, (F.sum(n).over(
        Window.partitionBy(shard).orderBy(bucket)) - F.col(n)).alias(base))
    placed = classes.join(F.broadcast(offsets), [shard, bucket])
    pieces = (placed.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(chunk))))
                    .withColumn(n, F.least(F.col(n) - F.col(part), F.lit(chunk)))
                    .withColumn(start, F.col(base) + F.col(start) + F.col(part)))
    out = pieces.withColumn(slot, F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)))
    return out.select(*names, F.col(slot))
