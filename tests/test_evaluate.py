import numpy as np
import pandas as pd
import pytest

from resolva.operators import evaluate as ev


def _scored(spark, p, y, parts=8):
    pdf = pd.DataFrame({"p": np.asarray(p, dtype=float), "y": np.asarray(y, dtype=int)})
    return spark.createDataFrame(pdf).repartition(parts)


def _brute_auc(p, y):
    p, y = np.asarray(p, float), np.asarray(y, int)
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _macro(p, y, t):
    pred = (np.asarray(p) >= t).astype(int)
    y = np.asarray(y)
    tp = int(((pred == 1) & (y == 1)).sum()); fp = int(((pred == 1) & (y == 0)).sum())
    fn = int(((pred == 0) & (y == 1)).sum()); tn = int(((pred == 0) & (y == 0)).sum())
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    f0 = 2 * tn / (2 * tn + fn + fp) if 2 * tn + fn + fp else 0.0
    return (f0 + f1) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_matches_pairwise_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(3000), 2)          # heavy ties
    y = (rng.random(3000) < 0.3 + 0.4 * p).astype(int)
    got = ev.roc_auc(_scored(spark, p, y), buckets=5).first()["roc_auc"]
    assert got == pytest.approx(_brute_auc(p, y), abs=1e-12)


def test_auc_partition_invariant_and_hot_score(spark):
    rng = np.random.default_rng(7)
    p = np.where(rng.random(4000) < 0.34, 0.5, rng.random(4000))   # a third of rows share one score
    y = (rng.random(4000) < p).astype(int)
    a1 = ev.roc_auc(_scored(spark, p, y, 1), buckets=3).first()["roc_auc"]
    a8 = ev.roc_auc(_scored(spark, p, y, 8), buckets=40).first()["roc_auc"]
    assert a1 == pytest.approx(a8, abs=1e-12) == pytest.approx(_brute_auc(p, y), abs=1e-12)


def test_auc_single_class_is_null(spark):
    assert ev.roc_auc(_scored(spark, [0.1, 0.2], [1, 1])).first()["roc_auc"] is None


def test_sweep_matches_81_explicit_thresholds(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(2000), 3)
    y = (rng.random(2000) < p).astype(int)
    sw = ev.threshold_sweep(_scored(spark, p, y)).orderBy("i").toPandas()
    assert len(sw) == 81
    assert np.allclose(sw.f1_macro, [_macro(p, y, t) for t in ev.THRESHOLDS], atol=0, rtol=0)
    best = ev.best_threshold(ev.threshold_sweep(_scored(spark, p, y))).first()
    ref = max(range(81), key=lambda i: (_macro(p, y, ev.THRESHOLDS[i]), -i))
    assert best["threshold"] == ev.THRESHOLDS[ref]


def test_grid_values():
    assert len(ev.THRESHOLDS) == 81
    assert repr(ev.THRESHOLDS[35]) == "0.44999999999999984"
    assert repr(ev.THRESHOLDS[43]) == "0.5299999999999998"


def test_constant_score_threshold_tie_goes_to_smallest(spark):
    # constant score 0.59: every t <= 0.59 predicts all positive → same F1; smallest t wins
    sw = ev.threshold_sweep(_scored(spark, [0.59] * 10, [1, 0] * 5))
    assert ev.best_threshold(sw).first()["threshold"] == ev.THRESHOLDS[0]


def test_calibration_matches_quantile_bins(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(5000), 2)
    y = (rng.random(5000) < p).astype(int)
    got = ev.calibration_curve(_scored(spark, p, y), buckets=6).orderBy("bin").toPandas()
    edges = np.percentile(p, np.linspace(0, 1, 11) * 100)
    b = np.searchsorted(edges[1:-1], p)
    ref = pd.DataFrame({"b": b, "p": p, "y": y}).groupby("b").agg(n=("p", "size"), pp=("p", "mean"), pt=("y", "mean"))
    assert list(got.bin) == list(ref.index)
    assert np.allclose(got.prob_pred, ref.pp, atol=1e-12) and np.allclose(got.prob_true, ref.pt, atol=1e-12)
    assert list(got.n) == list(ref.n)


def test_metrics_at_clip_logloss_brier(spark):
    p = [0.0, 1.0, 0.3, 0.8]
    y = [0, 1, 1, 0]
    r = ev.metrics_at(_scored(spark, p, y), 0.5).first()
    pc = np.clip(np.array(p), 1e-15, 1 - 1e-15)
    yy = np.array(y)
    assert r["log_loss"] == pytest.approx(-np.mean(yy * np.log(pc) + (1 - yy) * np.log(1 - pc)))
    assert r["brier_score"] == pytest.approx(np.mean((pc - yy) ** 2))
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 1, 1)


def test_published_metric_rows_reproduce_from_cells(spark):
    # Confusion cells of published test rows → accuracy / macro-F1 (golden values)
    cells = [(235156, 83924, 85731, 101876, 0.6652, 0.6403), (235001, 84079, 88269, 99338, 0.6599, 0.6336),
             (319080, 0, 187607, 0, 0.6297, 0.3864)]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d, *_ in cells], "tn long, fp long, fn long, tp long")
    got = ev._with_rates(df).collect()
    for row, (*_, acc, f1) in zip(got, cells):
        assert round(row["accuracy"], 4) == acc
        assert round(row["f1_macro"], 4) == f1


def test_metric_rows_auc_uses_clipped_probabilities(spark):
    from resolva.plans.evaluation import metric_rows
    rows = [("validacao", "m", 1, 0.0), ("validacao", "m", 0, 1e-20), ("teste", "m", 1, 0.0), ("teste", "m", 0, 1e-20)]
    df = spark.createDataFrame(rows, "conjunto string, modelo string, y int, p double")
    got = {r["conjunto"]: r["roc_auc"] for r in metric_rows(df).collect()}
    assert got == {"validacao": 0.5, "teste": 0.5}      # both clip to 1e-15 → a tie


def test_auc_matches_mllib_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    p = np.round(rng.random(5000), 3)
    y = (rng.random(5000) < p).astype(int)
    df = _scored(spark, p, y)
    ours = ev.roc_auc(df, buckets=7).first()["roc_auc"]
    ml = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="yd", metricName="areaUnderROC",
                                       numBins=0).evaluate(df.withColumn("yd", F.col("y").cast("double")))
    assert ours == pytest.approx(ml, abs=1e-12)
