"""Sums of sparse model rows over the features of a table's rows.

A linear model (naive Bayes margins, additive n-gram scores) needs, for every
row, the weighted sum of the model rows of its features. Joining each
(row, feature) occurrence with its model row moves a class-wide vector per
occurrence. Here rows are dealt into blocks, a block asks for each distinct
feature once, and the occurrences are summed inside the block:

 1. rows with their block are written once (``materialize``), so both readers
    below see the same blocks, also after a lost executor;
 2. distinct (block, feature) pairs are joined with the model by feature: a
    feature that every row holds is one pair per block, not one per row;
 3. the model rows found go back to their block, where numpy adds them up in
    compressed sparse rows.

A block has at most ``BLOCK_ROWS`` rows of at most ``LONG_ROW`` features, and
fewer where the output is wide; a longer row is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import materialize, ship
from .rowgrams import flat

BLOCK_ROWS = 1 << 12
LONG_ROW = 1 << 10
CELLS = 1 << 22          # output cells of a block, and sparse entries added at a time
FULL = 4                 # model rows with more than 1 / FULL of all entries are added up whole
_PARTITION_BITS = 33     # of monotonically_increasing_id: rows of a partition


def with_blocks(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``_block``; a row with many features has its own."""
    return block_of(rows, width, F.size("features") > LONG_ROW)


def block_of(rows: DataFrame, width: int, long: Column) -> DataFrame:
    """``rows`` with ``_block``: runs of rows of one partition; ``long`` tells
    the rows that are a block of their own."""
    ship(rows.sparkSession)
    per = max(1, min(BLOCK_ROWS, CELLS // max(width, 1)))
    # the id is not deterministic: it gets a column of its own, used once it is written
    d = rows.withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND((1 << _PARTITION_BITS) - 1)
    run = (F.col("_id") - place + F.floor(place / per).cast("long")) * 2
    return d.withColumn("_block", F.when(long, F.col("_id") * 2 + 1).otherwise(run)).drop("_id")


def add_up(counts: np.ndarray, at: np.ndarray, weights: np.ndarray, lengths: np.ndarray,
           index: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) sums. Row r has ``counts[r]`` occurrences; occurrence j
    adds ``weights[j]`` times model row ``at[j]`` (none if negative), whose
    ``lengths`` entries lie in ``index`` and ``value``."""
    n = len(counts)
    out = np.zeros(n * width)
    row = np.repeat(np.arange(n), counts)
    starts = np.cumsum(lengths) - lengths
    found = at >= 0
    if np.isfinite(weights).all():
        full = lengths * FULL >= max(width, 1)
        if full.any():
            _add_full(out.reshape(n, width), row, at, weights, np.flatnonzero(full), starts, lengths, index, value)
            found &= ~full[at]
    row, at, weights = row[found], at[found], weights[found]
    ends = np.cumsum(lengths[at])
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CELLS, total, CELLS), "right"), [len(at)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        a = at[lo:hi]
        size = lengths[a]
        entry = np.repeat(starts[a] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        base, top = row[lo] * width, (row[hi - 1] + 1) * width
        cell = np.repeat(row[lo:hi] * width - base, size) + index[entry]
        out[base:top] += np.bincount(cell, np.repeat(weights[lo:hi], size) * value[entry], top - base)
    return out.reshape(n, width)


def _add_full(out: np.ndarray, row: np.ndarray, at: np.ndarray, weights: np.ndarray, full: np.ndarray,
              starts: np.ndarray, lengths: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
    """Adds the model rows ``full``, laid out over the whole width, row by row."""
    width = out.shape[1]
    step = max(1, CELLS // width)
    for lo in range(0, len(full), step):
        part = full[lo:lo + step]
        size = lengths[part]
        entry = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(np.arange(len(part)) * width, size) + index[entry]
        laid = np.bincount(cell, value[entry], len(part) * width).reshape(len(part), width)
        place = np.full(len(lengths) + 1, -1)        # the last one: no model row
        place[part] = np.arange(len(part))
        mine = place[at]
        here = np.flatnonzero(mine >= 0)
        if len(here):
            own, mine, w = row[here], mine[here], weights[here]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out[own[a]] += w[a:b] @ laid[mine[a:b]]


def flat_model(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, ``idx`` and ``val`` of model rows; null is a row of no entries."""
    lengths, index = flat(table["idx"])
    return lengths, index.to_numpy(zero_copy_only=False), flat(table["val"])[1].to_numpy(zero_copy_only=False)


def _block_function(keys: list[str], width: int):
    def sums(rows: pa.Table, model: pa.Table) -> pa.Table:
        counts, features = flat(rows["features"])
        weights = flat(rows["weights"])[1].to_numpy(zero_copy_only=False) if "weights" in rows.column_names else np.ones(len(features))
        at = pc.index_in(features, model["feature"].combine_chunks()).fill_null(-1).to_numpy()
        out = add_up(counts, at, weights, *flat_model(model), width)
        offsets = pa.array(np.arange(len(counts) + 1) * width, pa.int32())
        return pa.table([*(rows[k] for k in keys), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))],
                        [*keys, "sums"])
    return sums


def block_sums(rows: DataFrame, keys: list[str], table: DataFrame, width: int) -> DataFrame:
    """(keys, sums array<double> of ``width``) for every row of ``rows``:
    ``keys``, ``features`` array<string> (repeats count) and, unless each
    occurrence weighs 1, ``weights`` array<double> beside it. ``table`` has one
    (feature, idx array<int>, val array<double>) row per known feature; unknown
    features add nothing. ``keys`` are carried along and need not be unique; a
    row without features gets zeros."""
    blocked = materialize(with_blocks(rows, width))
    asked = blocked.select(F.col("_block").alias("_by"), F.explode("features").alias("feature")).distinct()
    found = asked.join(table.select("feature", "idx", "val"), on="feature")
    schema = StructType([*(blocked.schema[k] for k in keys), StructField("sums", ArrayType(DoubleType()))])
    return (blocked.groupBy("_block").cogroup(found.groupBy("_by"))
                   .applyInArrow(_block_function(keys, width), schema))
