"""Golden selections from published tuning rows, and plan-shape checks."""

from pyspark.sql import functions as F

from resolva import registry as R
from resolva.operators import evaluate as ev
from resolva.operators import reports as rp

from .conftest import SF_ORACLE

# Published validation tuning rows: (model, configuration, macro-F1, Brier, log loss).
TUNING = [
    ("XGBoost", "XGB_medio", 0.6401, 0.2282, 0.6486), ("XGBoost", "XGB_simples", 0.6393, 0.2304, 0.6533),
    ("XGBoost", "XGB_robusto", 0.6383, 0.2296, 0.6515), ("LR", "LR_C_0.1", 0.6317, 0.2226, 0.6368),
    ("LR", "LR_C_1.0", 0.6316, 0.2228, 0.6372), ("LR", "LR_C_10.0", 0.6315, 0.2229, 0.6376),
    ("SVM", "SVM_C_0.1", 0.6305, 0.2299, 0.6523), ("SVM", "SVM_C_1.0", 0.6302, 0.2302, 0.6528),
    ("SVM", "SVM_C_10.0", 0.6301, 0.2303, 0.6531), ("TREE", "TREE_media", 0.6198, 0.2260, 0.6440),
    ("TREE", "TREE_complexa", 0.6194, 0.2262, 0.6449), ("TREE", "TREE_simples", 0.6159, 0.2279, 0.6480),
]


def test_best_config_golden(spark):
    df = spark.createDataFrame(TUNING, "modelo string, configuracao string, f1_macro double, "
                                       "brier_score double, log_loss double")
    by_f1 = {r["modelo"]: r["configuracao"] for r in rp.best_config(df).collect()}
    by_prob = {r["modelo"]: r["configuracao"] for r in rp.best_config(df, by_probability=True).collect()}
    assert by_f1 == {"XGBoost": "XGB_medio", "LR": "LR_C_0.1", "SVM": "SVM_C_0.1", "TREE": "TREE_media"}
    assert by_prob == {"XGBoost": "XGB_medio", "LR": "LR_C_0.1", "SVM": "SVM_C_0.1", "TREE": "TREE_media"}
    best = {r["criterio"]: r["modelo"] for r in rp.best_model(df).collect()}
    assert best == {"classificacao": "XGBoost", "probabilidade": "LR"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_reads_prune_year_partitions(spark):
    plan = _plan(R.QUERIES["modelling_set"](spark, SF_ORACLE))
    assert "PartitionFilters: [isnotnull(ano_finalizacao" in plan or "PartitionFilters: [(ano_finalizacao" in plan


def test_profile_reads_only_needed_columns(spark):
    plan = _plan(R.QUERIES["top_segments"](spark, SF_ORACLE))
    assert "ReadSchema: struct<segmento_de_mercado:string,target_resolvida:int>" in plan


def test_auc_plan_has_no_global_window_over_rows(spark):
    scored = spark.range(0, 1000).selectExpr("CAST(id % 2 AS INT) AS y", "(id % 97) / 97.0 AS p")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(ev.roc_auc(scored, buckets=4))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    # in-bucket running sums are partitioned by bucket; the only unpartitioned
    # window is over the per-bucket totals (≤ buckets rows)
    assert any("[bucket" in ln.split("]")[-2] or "bucket" in ln for ln in windows)


def test_salted_top_k_exact_with_hot_group(spark):
    import numpy as np
    import pandas as pd

    from resolva.operators.profile import top_k_per_group
    rng = np.random.default_rng(9)
    n = 6000
    grp = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c"], n))   # a third in one group
    pdf = pd.DataFrame({"campo": grp, "valor": [f"v{i}" for i in range(n)], "quantidade": rng.integers(0, 50, n)})
    got = top_k_per_group(spark.createDataFrame(pdf), ["campo"], [F.desc("quantidade")], 25, "valor",
                          salt_buckets=16).toPandas()
    ref = (pdf.sort_values(["campo", "quantidade", "valor"], ascending=[True, False, True])
              .groupby("campo").head(25))
    assert sorted(zip(got.campo, got.valor)) == sorted(zip(ref.campo, ref.valor))
    assert got.groupby("campo")["rank"].max().eq(25).all()
