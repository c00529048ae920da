"""Sinks. Outputs go to folders (one file per task), never to one file
gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV with a header row, no index."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def append_catalog(df: DataFrame, path: str) -> None:
    """Catalogue append: new rows added to a shared Parquet folder."""
    df.write.mode("append").parquet(path)


def write_partitioned_corpus(df: DataFrame, path: str, by: list[str], text_col: str, rows_per_file: int = 10_000_000) -> None:
    """One folder per (unit, label): plain text, one sentence per line. Rows
    are rebalanced by ``by``: small labels share a task and have one file, a
    large one is split by its bytes; no file has more than ``rows_per_file``."""
    rows = df.select(*by, F.col(text_col).alias("value")).hint("rebalance", *[F.col(c) for c in by])
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_tsv(df.select("gold", "pred"), path)


def append_experiment(record: DataFrame, path: str) -> None:
    """Experiment log: each run appends its record(s) as JSON lines."""
    record.write.mode("append").json(path)
