"""Ordered-line operators (transcripts, SGML-ish streams): carry-forward of
the last marker, islands between start/end markers, look-ahead.

A single file may hold a large share of all lines, so the carry-forward is
a two-level scan instead of one window over the whole file: lines are cut
into fixed-width blocks of the order key, each block's last marker is
found with an aggregate, the block summaries (few rows per file) are
scanned per file, and the final window runs inside a block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def carry_forward(df: DataFrame, part: list[str], order: str, value: Column, out: str,
                  block: int | None = DEFAULT_BLOCK, default=None) -> DataFrame:
    """``out`` := the last non-NULL ``value`` at or before each row in
    ``order`` within ``part`` (``default`` before the first one). ``order``
    must be a non-negative integer key."""
    d = df.withColumn("_v", value)
    if block is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        res = d.withColumn(out, F.last("_v", ignorenulls=True).over(w))
    else:
        d = d.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
        last_in = (d.where(F.col("_v").isNotNull()).groupBy(*part, "_blk")
                    .agg(F.max_by("_v", order).alias("_lb")))
        blocks = d.select(*part, "_blk").distinct().join(last_in, on=[*part, "_blk"], how="left")
        wb = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        prior = blocks.withColumn("_prior", F.last("_lb", ignorenulls=True).over(wb)).drop("_lb")
        w = (Window.partitionBy(*part, "_blk").orderBy(order)
                   .rowsBetween(Window.unboundedPreceding, 0))
        res = (d.join(prior, on=[*part, "_blk"], how="left")
                .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_prior")))
                .drop("_blk", "_prior"))
    if default is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return res.drop("_v")


def speaker_marker(text: Column, strict: bool = False, markers=("A", "B")) -> Column:
    """Speaker switched on by a line: contains ``A:`` (checked first) or
    ``B:``; strict: the line equals ``A:`` / ``B:``."""
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        cond = (F.trim(text) == f"{m}:") if strict else text.contains(f"{m}:")
        out = F.when(cond, F.lit(m)).otherwise(out)
    return out


def speaker_carry(lines: DataFrame, file_col: str, line_col: str, text_col: str,
                  strict: bool = False, block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Speaker per line (starts as A), marker text removed from the line."""
    out = carry_forward(lines, [file_col], line_col, speaker_marker(F.col(text_col), strict),
                        "speaker", block, default="A")
    t = F.col(text_col)
    cleaned = (F.when(t.contains("A:"), F.replace(t, F.lit("A:"), F.lit("")))
                .when(t.contains("B:"), F.replace(t, F.lit("B:"), F.lit("")))
                .otherwise(t))
    return out.withColumn(text_col, cleaned)


def running_sums(df: DataFrame, part: list[str], order: str, values: dict,
                 block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Running sums (rows up to and including the current one, in ``order``
    within ``part``) of the given columns: {out_name: column}. Two-level:
    per-block totals are prefix-summed over the (few) blocks of a file, then
    added to the running sum inside the block."""
    d = df
    for name, col in values.items():
        d = d.withColumn(f"_x_{name}", col.cast("long"))
    if block is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        for name in values:
            d = d.withColumn(name, F.sum(f"_x_{name}").over(w))
        return d.drop(*[f"_x_{n}" for n in values])
    d = d.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    tot = d.groupBy(*part, "_blk").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in values])
    wb = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for n in values:
        tot = tot.withColumn(f"_p_{n}", F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)))
    tot = tot.select(*part, "_blk", *[f"_p_{n}" for n in values])
    w = Window.partitionBy(*part, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(tot, on=[*part, "_blk"], how="left")
    for n in values:
        d = d.withColumn(n, F.sum(f"_x_{n}").over(w) + F.col(f"_p_{n}"))
    return d.drop("_blk", *[f"_x_{n}" for n in values], *[f"_p_{n}" for n in values])


def islands(lines: DataFrame, part: list[str], order: str, is_start: Column, is_open: Column,
            is_close: Column, group_col: str = "group_no", block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Group number = running count of start markers; a line is inside a
    group when an open marker has been seen after the last close marker
    (running sums; the close line itself is excluded)."""
    d = running_sums(lines, part, order, {group_col: is_start.cast("int"), "_opens": is_open.cast("int"),
                                          "_closes": is_close.cast("int")}, block)
    return d.withColumn("inside", (F.col("_opens") > F.col("_closes"))).drop("_opens", "_closes")


def lead_marker(lines: DataFrame, part: list[str], order: str, text_col: str, marker: str,
                strip: str = "", out_col: str = "next_text", block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Where line i and line i+1 both contain the marker, emit line i+1
    (with the ``strip`` prefix removed): look-ahead with ``lead``, inside
    a block, and across block borders through the first line of the next
    non-empty block."""
    if block is None:
        w = Window.partitionBy(*part).orderBy(order)
        d = lines.withColumn(out_col, F.lead(F.col(text_col)).over(w))
    else:
        d = lines.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
        w = Window.partitionBy(*part, "_blk").orderBy(order)
        d = (d.withColumn(out_col, F.lead(F.col(text_col)).over(w))
              .withColumn("_nxo", F.lead(F.col(order)).over(w)))
        firsts = d.groupBy(*part, "_blk").agg(F.min_by(F.col(text_col), F.col(order)).alias("_first"))
        wb = Window.partitionBy(*part).orderBy("_blk")
        nxt = firsts.withColumn("_next_first", F.lead("_first").over(wb)).drop("_first")
        d = (d.join(nxt, on=[*part, "_blk"], how="left")
              .withColumn(out_col, F.when(F.col("_nxo").isNull(), F.col("_next_first"))
                                    .otherwise(F.col(out_col)))
              .drop("_blk", "_nxo", "_next_first"))
    d = d.where(F.col(text_col).contains(marker) & F.col(out_col).contains(marker))
    if strip:
        d = d.withColumn(out_col, F.replace(F.col(out_col), F.lit(strip), F.lit("")))
    return d
