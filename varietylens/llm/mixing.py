"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes are word counts; sources in code-point order (null last) get the
   repeating ``weights`` and share ``budget`` times all words; a source stops
   at ``cap`` times its own words and the excess is shared again by weight.
2. A source's target is whole passes over it plus a remaining budget. The
   budget is fitted on the source's histogram of exact document sizes: the
   same share of every size first, then single documents by largest
   remainder, then a bounded-knapsack table over the last words: ``REACH`` times
   the longest document (``table`` words at least), for every source alike. It
   finds the best sum of what is left; what is missed is less than the shortest
   document left.
3. The documents of a size are chosen by a seeded hash: hash buckets are
   counted, so only the bucket in which the quota ends is ranked.

Null or empty texts have size 0; a null source is a source of its own.
Repeated rows are documents of their own. Other columns are carried along.
The histogram of a source has one row per distinct size, at most
sqrt(2 x its words) rows; the table of sources has one row per source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, ship

REACH = 8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted
    shares of the budget, none above ``cap`` times the source's size."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    t = (sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
              .withColumn("all", F.sum("source_size").over(everything) * float(budget)))
    # Sources reach their cap in the order of cap / weight.
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    t = (t.withColumn("capped", F.sum("most").over(upto))
          .withColumn("open", F.sum("w").over(everything) - F.sum("w").over(upto)))
    level = F.col("all") - F.col("capped")
    # capped if the sources after it could take more than it at its own cap
    t = t.withColumn("full", level >= F.col("most") / F.col("w") * F.col("open"))
    t = (t.withColumn("given", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything))
          .withColumn("rest", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)))
    share = (F.col("all") - F.col("given")) * F.col("w") / F.col("rest")
    return t.select("source", "source_size",
                    F.when(F.col("full"), F.col("most")).otherwise(F.least(share, "most")).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, table: int = 8192) -> np.ndarray:
    """How many documents of each size to take (0 .. counts) so that the
    words come as near below ``budget`` as the table over the last words
    allows."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if total <= budget:
        return counts.copy()
    table = max(table, REACH * int(sizes[counts > 0].max()))
    share = counts * (max(0, budget - table) / total)  # what the table can fit is left to it
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    while int((take * sizes).sum()) > budget:  # rounding of huge counts
        take = np.maximum(take - 1, 0)
    rest = budget - int((take * sizes).sum())
    order = np.lexsort((-sizes, -(share - np.floor(share))))
    for most in (1, None):
        for i in order:
            if rest <= table:
                break
            left = int(counts[i] - take[i])
            n = min(left, rest // max(int(sizes[i]), 1), *([most] if most else []))
            if sizes[i] and n > 0:
                take[i] += n
                rest -= n * int(sizes[i])
    # Bounded knapsack over the last words: counts in binary pieces, each sum
    # remembers the piece that first reached it.
    rest = min(rest, table)
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    by = np.full(rest + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i] - take[i])
        if not size or size > rest:
            continue
        left, step = min(left, rest // size), 1
        while left > 0 and not reach[rest]:
            n = min(step, left)
            left, step = left - n, step * 2
            if n * size > rest:
                continue
            new = ~reach
            new[:n * size] = False
            new[n * size:] &= reach[:rest + 1 - n * size]
            by[new] = len(pieces)
            reach |= new
            pieces.append((int(i), n))
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = pieces[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = int(target // size) if size else 0
    left = int(target - passes * size)
    extra = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), left) if left > 0 else 0
    return pd.DataFrame({"p_source": group["source"], "p_size": group["size"], "passes": passes, "extra": extra})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17,
        buckets: int = 256) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and
    ``mix_copies`` (how often the mix takes the document) as last columns; a
    name that ``docs`` has already gets a longer one."""
    ship(docs.sparkSession)
    names = docs.columns
    src, size, h, b, rank = (fresh(docs, c) for c in ("m_source", "m_size", "m_hash", "m_bucket", "m_rank"))
    rows = (docs.withColumn(src, F.col(source)).withColumn(size, word_count(F.col(text)))
                .withColumn(h, F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size), F.crc32(F.col(text).cast("binary"))))
                .withColumn(b, F.pmod(F.col(h), F.lit(buckets))))
    cells = materialize(rows.groupBy(F.col(src).alias("source"), F.col(size).alias("size"), F.col(b).alias("bucket"))
                            .agg(F.count("*").alias("n")))
    hist = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = materialize(source_targets(
        hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget, cap))
    t = targets.withColumnRenamed("source", "t_source")
    plan = (hist.join(t, F.col("source").eqNullSafe(F.col("t_source")))
                .groupBy("source").applyInPandas(_plan, "p_source string, p_size long, passes long, extra long"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    quota = (cells.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
                  .withColumn("need", F.col("extra") - F.sum("n").over(before) + F.col("n"))
                  .join(t, F.col("source").eqNullSafe(F.col("t_source")))
                  .select("source", "size", "bucket", "passes", "need", "source_size", "target"))
    quota = materialize(quota)
    q = {c: fresh(rows, f"q_{c}") for c in quota.columns}
    quota = quota.select(*[F.col(c).alias(q[c]) for c in quota.columns])
    joined = rows.join(quota, rows[src].eqNullSafe(quota[q["source"]]) & (rows[size] == quota[q["size"]])
                       & (rows[b] == quota[q["bucket"]]))
    order = Window.partitionBy(src, size, b).orderBy(h, doc_id)
    joined = joined.withColumn(rank, F.row_number().over(order))
    copies = F.col(q["passes"]) + F.when(F.col(rank) <= F.col(q["need"]), 1).otherwise(0)
    added = {"mix_size": F.col(size), "mix_source_size": F.col(q["source_size"]), "mix_target": F.col(q["target"]),
             "mix_copies": copies}
    return joined.select(*names, *(c.alias(fresh(docs, name)) for name, c in added.items()))
