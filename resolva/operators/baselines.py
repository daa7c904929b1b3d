"""Rate baselines: global training mean and group target mean.

Both produce a scored table `(…, y, p)` that the evaluation layer reads.
The group-rate table has one row per group; pass it through
`frames.as_lookup`, which broadcasts it when its counted rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TARGET

# Baseline model names.
BASELINE_GLOBAL = "Baseline - média geral"
BASELINE_GROUP = "Baseline - média por Grupo Problema"
BASELINE_PREFIX = "Baseline"


def global_rate(train: DataFrame) -> float:
    """Training resolution rate (one number to the driver)."""
    return train.agg(F.avg(F.col(TARGET).cast("double")).alias("r")).first()["r"]


def group_rates(train: DataFrame, group: str) -> DataFrame:
    return train.groupBy(group).agg(F.avg(F.col(TARGET).cast("double")).alias("taxa_grupo"),
                                    F.count(F.lit(1)).alias("n_grupo"))


def score_global(df: DataFrame, rate: float, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(*keep, F.col(TARGET).cast("int").alias("y"), F.lit(float(rate)).alias("p"))


def score_group(df: DataFrame, rates: DataFrame, group: str, rate: float,
                keep: list[str] | None = None) -> DataFrame:
    """Group mean of the training target; unseen groups get the global rate."""
    keep = keep or []
    return (df.join(rates.select(group, "taxa_grupo"), group, "left")
              .select(*keep, F.col(TARGET).cast("int").alias("y"),
                      F.coalesce(F.col("taxa_grupo"), F.lit(float(rate))).alias("p")))


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced class weights n / (2 · n_c) per target value (2-row window)."""
    c = train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_classe"))
    n = F.sum("n_classe").over(Window.partitionBy())
    return c.select(TARGET, "n_classe", (n / (2.0 * F.col("n_classe"))).alias("peso"))
