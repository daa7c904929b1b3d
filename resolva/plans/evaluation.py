"""Score → choose threshold on validation → metric rows for validation and test.

All models are evaluated together: the scored rows of every (split, model)
sit in one DataFrame and every metric is grouped by (conjunto, modelo), so
N models cost the same number of passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import as_lookup
from ..operators import baselines as bl
from ..operators import evaluate as ev
from ..sources.tables import union_by_name

# Split names used in metric rows, and the metric-row layout.
VALID, TEST = "validacao", "teste"
METRIC_COLUMNS = [
    "conjunto", "modelo", "threshold", "accuracy", "precision_resolvida", "recall_resolvida",
    "f1_resolvida", "precision_macro", "recall_macro", "f1_macro", "roc_auc", "log_loss",
    "brier_score", "tn_nao_resolvida", "fp_nao_resolvida_classificada_como_resolvida",
    "fn_resolvida_classificada_como_nao_resolvida", "tp_resolvida",
]


def choose_thresholds(scored: DataFrame) -> DataFrame:
    """Per model: the grid threshold with the best macro-F1 on validation."""
    valid = scored.filter(F.col("conjunto") == VALID)
    return ev.best_threshold(ev.threshold_sweep(valid, by=["modelo"]), by=["modelo"])


def at_validation_best(sweep: DataFrame, keys: list[str], split: str = "conjunto", valid: str = VALID) -> DataFrame:
    """The sweep rows of every split at the threshold whose macro-F1 is best on
    validation (ties: the smallest). A window sees the 81 thresholds of one
    model's splits."""
    first = Window.partitionBy(*keys).orderBy(F.desc(F.col(split) == valid), F.desc("f1_macro"), F.asc("i"))
    best = F.first(F.struct(split, "i")).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sweep.withColumn("_best", best).filter((F.col(f"_best.{split}") == valid) & (F.col("_best.i") == F.col("i"))).drop("_best")


def metric_rows(scored: DataFrame, thresholds: DataFrame | None = None, buckets: int | None = None,
                keys: tuple[str, ...] = ("modelo",)) -> DataFrame:
    """Metric rows per (conjunto, modelo) at each model's validation threshold.

    `scored`: conjunto, modelo, y, p; `keys` names what tells models apart. The scored rows are read once, into counts
    per (conjunto, modelo, score); thresholds, confusion cells, losses and AUC
    all come from those counts, so no scored row is stored or joined.
    `thresholds` (modelo, threshold) replaces the validation choice; it has one
    row per model and is broadcast.
    """
    by = ["conjunto", *keys]
    counts = ev.score_counts(scored, by, clip=True).checkpoint(eager=True)
    if thresholds is None:
        cells = at_validation_best(ev.sweep(counts, by), list(keys))
    else:
        cells = ev.cells_at(counts.join(F.broadcast(thresholds.select(*keys, "threshold")), list(keys)), "threshold", by)
    out = cells.join(ev.losses(counts, by), by).join(ev.auc(counts, by, buckets), by, "left")
    return out.select(
        *by, *METRIC_COLUMNS[2:13],
        F.col("tn").alias("tn_nao_resolvida"),
        F.col("fp").alias("fp_nao_resolvida_classificada_como_resolvida"),
        F.col("fn").alias("fn_resolvida_classificada_como_nao_resolvida"),
        F.col("tp").alias("tp_resolvida"))


def baseline_scores(splits: dict[str, DataFrame], group: str = "grupo_problema") -> DataFrame:
    """Scored rows of both baselines on validation and test."""
    train = splits["train"]
    rate = bl.global_rate(train)
    rates = as_lookup(bl.group_rates(train, group))
    parts = []
    for conj, key in ((VALID, "valid"), (TEST, "test")):
        df = splits[key]
        parts.append(bl.score_global(df, rate, ["case_id"])
                     .withColumn("modelo", F.lit(bl.BASELINE_GLOBAL)).withColumn("conjunto", F.lit(conj)))
        parts.append(bl.score_group(df, rates, group, rate, ["case_id"])
                     .withColumn("modelo", F.lit(bl.BASELINE_GROUP)).withColumn("conjunto", F.lit(conj)))
    return union_by_name(parts).select("conjunto", "modelo", "case_id", "y", "p")
