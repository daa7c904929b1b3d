"""Configuration grid evaluated on validation, one grouped evaluation pass.

Rate models (target mean per group of one or two case fields, unseen
groups → training mean) are the SQL-checkable model family; the fitted
`pyspark.ml` families run through the same `grid_results` once scored
(see `plans.training`). Every configuration's validation rows are stacked
into one DataFrame keyed by (modelo, configuracao), so the threshold sweep,
the metrics and the ROC-AUC each run once for the whole grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import as_lookup
from ..operators import baselines as bl
from ..operators import evaluate as ev
from ..schema import TARGET
from ..sources.tables import union_by_name
from .evaluation import VALID, at_validation_best

# The rate-model grid (model name, family, configuration → grouping columns).
RATE_MODEL_ONE = "Taxa por grupo"
RATE_MODEL_TWO = "Taxa por par de grupos"
RATE_FAMILY = "Codificação por alvo"
RATE_GRID = [
    (RATE_MODEL_ONE, "TE_grupo_problema", ["grupo_problema"]),
    (RATE_MODEL_ONE, "TE_segmento_de_mercado", ["segmento_de_mercado"]),
    (RATE_MODEL_ONE, "TE_uf", ["uf"]),
    (RATE_MODEL_TWO, "TE_grupo_problema_x_segmento", ["grupo_problema", "segmento_de_mercado"]),
    (RATE_MODEL_TWO, "TE_grupo_problema_x_canal", ["grupo_problema", "canal_de_origem"]),
    (RATE_MODEL_TWO, "TE_regiao_x_segmento", ["regiao", "segmento_de_mercado"]),
]

GRID_COLUMNS = ["modelo", "familia", "configuracao", "params", "threshold", "accuracy",
                "precision_macro", "recall_macro", "f1_macro", "precision_resolvida",
                "recall_resolvida", "f1_resolvida", "roc_auc", "log_loss", "brier_score",
                "tn", "fp", "fn", "tp"]


def rate_tables(train: DataFrame, grid=RATE_GRID) -> DataFrame:
    """Every configuration's group rates from ONE pass over train (GROUPING SETS).

    Output: one row per (configuration, group): the grouping columns (NULL
    where a configuration does not group by them), `_gid` and `taxa_grupo`.
    """
    cols = sorted({c for _, _, cs in grid for c in cs})
    sets = [[F.col(c) for c in cs] for _, _, cs in grid]
    return (train.groupingSets(sets, *cols)
                 .agg(F.avg(F.col(TARGET).cast("double")).alias("taxa_grupo"),
                      F.grouping_id().alias("_gid")))


def _gid(cols_all: list[str], used: list[str]) -> int:
    """grouping_id value of a grouping set: bit set for each column NOT grouped."""
    g = 0
    for c in cols_all:
        g = (g << 1) | (0 if c in used else 1)
    return g


def rate_scores(train: DataFrame, target_df: DataFrame, grid=RATE_GRID) -> DataFrame:
    """Scored rows (modelo, familia, configuracao, params, case_id, y, p) of every config."""
    rate = bl.global_rate(train)
    cols_all = sorted({c for _, _, cs in grid for c in cs})
    tables = rate_tables(train, grid).checkpoint(eager=True)      # read once per configuration
    parts = []
    for model, config, cols in grid:
        rates = as_lookup(tables.filter(F.col("_gid") == _gid(cols_all, cols)).select(*cols, "taxa_grupo"))
        scored = (target_df.join(rates, cols, "left")
                           .select("case_id", F.col(TARGET).cast("int").alias("y"),
                                   F.coalesce("taxa_grupo", F.lit(float(rate))).alias("p")))
        parts.append(scored.select(F.lit(model).alias("modelo"), F.lit(RATE_FAMILY).alias("familia"),
                                   F.lit(config).alias("configuracao"),
                                   F.lit("{'colunas': " + repr(cols) + "}").alias("params"),
                                   "case_id", "y", "p"))
    return union_by_name(parts)


def grid_results(scored: DataFrame, buckets: int | None = None) -> DataFrame:
    """One result row per configuration, threshold chosen on the same rows."""
    keys = ["modelo", "familia", "configuracao", "params"]
    counts = ev.score_counts(scored, keys, clip=True).checkpoint(eager=True)
    cells = at_validation_best(ev.sweep(counts, keys).withColumn("conjunto", F.lit(VALID)), keys)
    return cells.join(ev.losses(counts, keys), keys).join(ev.auc(counts, keys, buckets), keys, "left").select(*GRID_COLUMNS)
