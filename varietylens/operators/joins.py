"""Join helpers and the equi-join operators of the corpus ETL.

Joins carry no hints: Catalyst and AQE broadcast by the measured bytes and
split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known_rows(df: DataFrame) -> int:
    n = getattr(df, "_vl_rows", None)
    if n is None:
        n = df.count()
        try:
            df._vl_rows = n
        except Exception:  # pragma: no cover
            pass
    return n


def with_rows(df: DataFrame, n: int) -> DataFrame:
    """Record a known row count on a (materialised) frame."""
    df._vl_rows = n
    return df


def lookup_with_default(df: DataFrame, side: DataFrame, key: str, value_col: str,
                        default: str = "") -> DataFrame:
    """Left lookup; a missing key yields ``default``. The side table is
    de-duplicated on the key first (first value by order)."""
    one = side.groupBy(key).agg(F.min(value_col).alias(value_col))
    return (df.join(one, on=key, how="left")
              .withColumn(value_col, F.coalesce(F.col(value_col), F.lit(default))))


def lookup_recorded(df: DataFrame, side: DataFrame, key: str, value_col: str, path: str,
                    default: str = "") -> tuple[DataFrame, DataFrame, dict]:
    """(found, missed, counts): as ``lookup_with_default``, written once below
    ``path`` to a folder of the rows that had a value and one of those that got
    the default; counts (rows, missed) are taken while it is written. A value
    that is null counts as missing."""
    from pyspark.sql import Observation
    seen = Observation()
    one = side.groupBy(key).agg(F.min(value_col).alias(value_col))
    out = df.join(one, on=key, how="left").withColumn("missed", F.col(value_col).isNull())
    out = out.withColumn(value_col, F.coalesce(F.col(value_col), F.lit(default)))
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("missed").alias("missed"))
    out.write.partitionBy("missed").parquet(path)
    back = df.sparkSession.read.schema(out.schema).parquet(path)
    return back.where("not missed").drop("missed"), back.where("missed").drop("missed"), seen.get


def anti_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), on=key, how="left_anti")


def label_encode(df: DataFrame, label_col: str, out_col: str = "label_id") -> DataFrame:
    """Label -> dense integer id in sorted label order (0-based). The label
    vocabulary is aggregated first (distinct labels: the label set, not the
    rows), ranked in one small window, and joined back."""
    vocab = (df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
               .withColumn(out_col, F.dense_rank().over(Window.orderBy(label_col)) - 1))
    return df.join(vocab, on=label_col, how="left")

