"""Registered fixture queries: name -> (Spark callable, oracle SQL or None).

Every query reads the verification tables (whole tables, whole texts) and
returns a DataFrame whose column names match its oracle SQL. Floating
results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_model  # noqa: F401
    for mod in ("q_labels", "q_text", "q_etl", "q_lm", "q_stack", "q_layers", "q_files"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:  # modules land incrementally
            if mod not in str(e):
                raise
