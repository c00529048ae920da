"""Classification metrics at every level of the label hierarchy.

accuracy, and precision / recall / F1, micro and macro, where macro averages
over the union of gold and predicted labels and an undefined ratio is 0.
Levels: the city label ``a-b-c`` is scored, then ``b-c`` (country), then
``c`` (region) - the same rows, re-labelled by dropping the leading part.

Physical shape: rows are exploded into (level, gold, pred) and reduced to a
confusion table (level, gold, pred, count) with map-side partial counts;
every later step works on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LEVELS, drop_first_part, second_part

METRICS = ["accuracy", "f1_micro", "f1_macro", "recall_micro", "recall_macro",
           "precision_micro", "precision_macro"]


def level_pairs(df: DataFrame, level: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(level, gold, pred) rows for ``level`` and every coarser level."""
    g, p = F.col(gold), F.col(pred)
    items = []
    start = LEVELS.index(level)
    for lv in LEVELS[start:]:
        items.append(F.struct(F.lit(lv).alias("level"), g.alias("gold"), p.alias("pred")))
        if lv == "city":
            g, p = drop_first_part(g), drop_first_part(p)
        elif lv == "country":
            g, p = second_part(g), second_part(p)
    return df.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def confusion(pairs: DataFrame, by: list[str] = ("level",)) -> DataFrame:
    return pairs.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def metrics_from_confusion(conf: DataFrame, by: list[str] = ("level",)) -> DataFrame:
    """One row per group with the seven metrics and the row count."""
    by = list(by)
    eq = F.col("gold").eqNullSafe(F.col("pred"))
    tot = conf.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(eq, F.col("n")).otherwise(0)).alias("n_correct"))
    per_gold = conf.groupBy(*by, F.col("gold").alias("label")).agg(
        F.sum(F.when(eq, F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("gold_n"))
    per_pred = conf.groupBy(*by, F.col("pred").alias("label")).agg(
        F.sum("n").alias("pred_n"))
    per = (per_gold.join(per_pred, on=[*by, "label"], how="full_outer")
                   .fillna(0, subset=["tp", "gold_n", "pred_n"]))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("gold_n") > 0, F.col("tp") / F.col("gold_n")).otherwise(F.lit(0.0))
    per = per.withColumn("p", prec).withColumn("r", rec).withColumn(
        "f", F.when(F.col("p") + F.col("r") > 0,
                    2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0)))
    macro = per.groupBy(*by).agg(F.avg("p").alias("precision_macro"),
                                 F.avg("r").alias("recall_macro"),
                                 F.avg("f").alias("f1_macro"))
    acc = F.col("n_correct") / F.col("n_rows")
    out = (tot.join(macro, on=by, how="inner")
              .withColumn("accuracy", acc)
              .withColumn("precision_micro", acc)
              .withColumn("recall_micro", acc)
              .withColumn("f1_micro", acc))
    return out.select(*by, F.col("n_rows").cast("long").alias("n_rows"),
                      *[F.col(m).cast("double").alias(m) for m in METRICS])


def levels_eval(df: DataFrame, level: str = "city", gold: str = "gold", pred: str = "pred",
                extra_by: list[str] = ()) -> DataFrame:
    """Metrics for ``level`` and the coarser levels; ``extra_by`` keeps
    grouping columns (e.g. the evaluation split) in the output."""
    extra_by = list(extra_by)
    if extra_by:
        # carry grouping columns through the explode
        g, p = F.col(gold), F.col(pred)
        items = []
        for lv in LEVELS[LEVELS.index(level):]:
            items.append(F.struct(F.lit(lv).alias("level"), g.alias("gold"), p.alias("pred")))
            if lv == "city":
                g, p = drop_first_part(g), drop_first_part(p)
            elif lv == "country":
                g, p = second_part(g), second_part(p)
        pairs = df.select(*extra_by, F.explode(F.array(*items)).alias("r")).select(*extra_by, "r.*")
    else:
        pairs = level_pairs(df, level, gold, pred)
    by = [*extra_by, "level"]
    return metrics_from_confusion(confusion(pairs, by), by)
