"""Deterministic, exact-proportion data splits.

The reference permutes the rows with a seeded generator and cuts the
permutation at ``int(p_train*n)`` and ``int(p_train*n) + int(p_dev*n)``; the
test part is the rest. Here the permutation is the order of
``md5(seed || id)`` (ties by id), which is reproducible on any partitioning
and independent of row order.

The rank is computed without a global single-task window: rows are bucketed
by the leading hex digits of the hash, a small (group, bucket) count table
gives each bucket's offset, and ``row_number`` runs inside a bucket only.
Buckets are uniform because the hash is, so no bucket can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLIT_NAMES = ("train", "dev", "test")


def order_key(id_col: str, seed: int = 999):
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))


def exact_rank(df: DataFrame, id_col: str, seed: int = 999,
               group_cols: list[str] | tuple = (), bucket_hex: int = 4) -> DataFrame:
    """Add ``_rank`` (0-based position in the seeded permutation within each
    group) and ``_n`` (group size)."""
    g = list(group_cols)
    keyed = (df.withColumn("_h", order_key(id_col, seed))
               .withColumn("_b", F.substring("_h", 1, bucket_hex)))
    # (group, bucket) sizes: at most 16**bucket_hex rows per group, so the
    # prefix sums below run over a bounded table (a constant group when the
    # frame has no grouping columns), and the broadcast has a proven bound
    sizes = keyed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    gg = g or ["_g"]
    if not g:
        sizes = sizes.withColumn("_g", F.lit(0))
    wcum = Window.partitionBy(*gg).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = (sizes
               .withColumn("_off", F.sum("_cnt").over(wcum) - F.col("_cnt"))
               .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*gg)))
               .select(*g, "_b", "_off", "_n"))
    w = Window.partitionBy(*g, "_b").orderBy("_h", id_col)
    return (keyed.join(F.broadcast(offsets), on=[*g, "_b"], how="inner")
                 .withColumn("_rank", F.col("_off") + F.row_number().over(w) - 1)
                 .drop("_h", "_b", "_off"))


def exact_split(df: DataFrame, id_col: str, train: float = 0.8, dev: float = 0.1,
                seed: int = 999, group_cols: list[str] | tuple = (),
                split_col: str = "split") -> DataFrame:
    """Assign ``train``/``dev``/``test``: train is the first int(train*n)
    rows of the permutation, dev the next int(dev*n), test the rest."""
    ranked = exact_rank(df, id_col, seed, group_cols)
    train_end = F.floor(F.lit(float(train)) * F.col("_n"))
    dev_end = train_end + F.floor(F.lit(float(dev)) * F.col("_n"))
    return (ranked.withColumn(
                split_col,
                F.when(F.col("_rank") < train_end, F.lit(SPLIT_NAMES[0]))
                 .when(F.col("_rank") < dev_end, F.lit(SPLIT_NAMES[1]))
                 .otherwise(F.lit(SPLIT_NAMES[2])))
            .drop("_rank", "_n"))


def split_by_ids(df: DataFrame, ids: DataFrame, key: str, split_col: str = "split",
                 listed_null: str = "unassigned") -> DataFrame:
    """Split from an external id list: listed rows take the list's split (a
    listed row with a NULL split gets ``listed_null``); unlisted rows are
    dropped (inner join). The id list is de-duplicated on the key first, so
    a key with several entries keeps one (the smallest split name)."""
    lst = ids.groupBy(key).agg(F.min(split_col).alias(split_col))
    return (df.join(lst, on=key, how="inner")
              .withColumn(split_col, F.coalesce(F.col(split_col), F.lit(listed_null))))
