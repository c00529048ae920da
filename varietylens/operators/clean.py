"""Row-level cleaning operators: pre-clean, de-duplication, stacking,
marker-based line filters, sentinels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preclean(df: DataFrame, sentence_cols: list[str]) -> DataFrame:
    """Drop rows whose sentence column(s) are NULL; sentences become strings."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in sentence_cols])
    out = df.where(cond)
    for c in sentence_cols:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def dedupe_keep_first(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every distinct value.

    A hot value (one text copied a million times) is safe: the min is
    combined map-side before the shuffle, and only (hash, id) pairs move.
    The survivors are then picked by a semi join on the hash and ``order_col``.
    """
    digest = F.sha2(F.col(value_col).cast("string"), 256)
    keepers = (df.select(digest.alias("_d"), F.col(order_col).alias("_first"))
                 .groupBy("_d").agg(F.min("_first").alias("_first")))
    # by digest and order key: the key alone need not be unique
    return df.join(keepers, digest.eqNullSafe(keepers["_d"]) & (df[order_col] == keepers["_first"]), "left_semi")


def stack_columns_distinct(df: DataFrame, cols: list[str], out_col: str = "original_sentence") -> DataFrame:
    """Several sentence columns stacked into one, de-duplicated, NULLs dropped."""
    return (df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias(out_col))
              .where(F.col(out_col).isNotNull())
              .distinct())


def skip_preamble(lines: DataFrame, file_col: str, line_col: str, text_col: str,
                  marker: str) -> DataFrame:
    """Drop every line before the first marker line of each file, then all
    marker lines. Files without a marker keep nothing."""
    is_marker = F.col(text_col).contains(marker)
    first = (lines.where(is_marker).groupBy(file_col)
                  .agg(F.min(line_col).alias("_first_marker")))
    return (lines.join(first, on=file_col, how="inner")
                 .where((F.col(line_col) > F.col("_first_marker")) & ~is_marker)
                 .drop("_first_marker"))


def line_start_filter(df: DataFrame, text_col: str) -> DataFrame:
    """Drop empty lines and lines starting with a Latin letter or ``(``."""
    return df.where((F.col(text_col) != "") & ~F.col(text_col).rlike(r"^[(A-Za-z]"))


def sentinel_null(c, sentinels: list[str]):
    """Map sentinel strings (e.g. ``(na)``) to NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isin(*sentinels), F.lit(None).cast("string")).otherwise(col)


def exclude_values(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Rows whose ``col`` is not in a (small, literal) exclusion list."""
    if not values:
        return df
    return df.where(~F.col(col).isin(*values) | F.col(col).isNull())


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key (window bounded by the key group). Use only for
    side tables whose groups are small; hot keys in big tables should use an
    aggregate (min_by) instead."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
