"""Rule-driven label corrections: each rule is (predicate, {column: value});
every predicate and value reads the row as it was before any rule, and a
later rule wins where two rules set the same column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_corrections(df: DataFrame, rules: list[dict]) -> DataFrame:
    new = {}
    for rule in rules:
        for col, val in rule["set"].items():
            base = new.get(col, F.col(col))
            new[col] = F.when(rule["when"], val).otherwise(base)
    # one projection: all expressions see the original columns
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def cell_patch(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Positional cell patch: a patch table keyed by ``key`` overrides the
    non-NULL cells it carries (left join + coalesce)."""
    cols = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    out = df.join(p, on=key, how="left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_p_{c}"), F.col(c)))
    return out.drop(*[f"_p_{c}" for c in cols])
