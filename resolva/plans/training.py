"""Train → threshold on validation → metrics on validation and test → artefacts.

The encoder, its encoded rows and every fit are published once under the shared
checkpoint folder (`sources/publish.py`), keyed by the training rows' values and
the configuration, and reloaded by later steps and sessions (interpretation
tables, scoring), as the original flow saved its models for the later scripts.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.encode import Encoder, fit_encoder
from ..operators.evaluate import best_threshold, score_counts, sweep
from ..schema import TARGET
from ..session import scratch_path
from ..sources.publish import publish, rows_fingerprint
from ..sources.tables import union_by_name
from .evaluation import TEST, VALID, baseline_scores, metric_rows

# Final configurations of the original flow.
FINAL_SPECS = [
    M.Spec(M.LOGREG, "logreg", "LR_C_0.1", {"C": 0.1}),
    M.Spec(M.TREE, "tree", "TREE_media", {"max_depth": 20, "min_samples_leaf": 500}),
    M.Spec(M.GBT, "gbt", "GBT_medio", {"n_estimators": 250, "max_depth": 6, "learning_rate": 0.08,
                                       "min_child_weight": 3}),
    M.Spec(M.SVM, "svm", "SVM_C_0.1", {"C": 0.1}),
]

# The tuning grid.
TUNING_SPECS = [
    M.Spec(M.LOGREG, "logreg", "LR_C_0.1", {"C": 0.1}),
    M.Spec(M.LOGREG, "logreg", "LR_C_1.0", {"C": 1.0}),
    M.Spec(M.LOGREG, "logreg", "LR_C_10.0", {"C": 10.0}),
    M.Spec(M.TREE, "tree", "TREE_simples", {"max_depth": 10, "min_samples_leaf": 1000}),
    M.Spec(M.TREE, "tree", "TREE_media", {"max_depth": 20, "min_samples_leaf": 500}),
    M.Spec(M.TREE, "tree", "TREE_complexa", {"max_depth": 30, "min_samples_leaf": 200}),
    M.Spec(M.GBT, "gbt", "GBT_simples", {"n_estimators": 150, "max_depth": 4, "learning_rate": 0.10,
                                         "min_child_weight": 5}),
    M.Spec(M.GBT, "gbt", "GBT_medio", {"n_estimators": 250, "max_depth": 6, "learning_rate": 0.08,
                                       "min_child_weight": 3}),
    M.Spec(M.GBT, "gbt", "GBT_robusto", {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.05,
                                         "min_child_weight": 5}),
    M.Spec(M.SVM, "svm", "SVM_C_0.1", {"C": 0.1}),
    M.Spec(M.SVM, "svm", "SVM_C_1.0", {"C": 1.0}),
    M.Spec(M.SVM, "svm", "SVM_C_10.0", {"C": 10.0}),
]
# Family names in reports.
FAMILY_LABEL = {"logreg": "Linear / Regressores", "tree": "Árvores", "gbt": "Ensemble / Boosting", "svm": "SVM"}


#: Goes into the keys of saved fits; changes with the estimators' meaning.
FITTING = "4"


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps([FITTING, *parts], sort_keys=True).encode()).hexdigest()[:24]


def training_key(train: DataFrame, features: list[str]) -> str:
    """Key of everything fitted on these rows: their values and the features.
    Other sessions over the same rows get the same key."""
    return _digest(rows_fingerprint(train.select("case_id", TARGET, *features)), features, M.SEED)


def encoded_rows(train: DataFrame, features: list[str], key: str | None = None) -> tuple[Encoder, DataFrame]:
    """The encoder and the encoded training rows that all families share, all
    of them, written once."""
    spark = train.sparkSession
    key = key or training_key(train, features)

    def write(path: str) -> None:
        rows = train.select("case_id", TARGET, *features)
        encoder = fit_encoder(rows, features)
        encoder.pipeline.write().save(path + "/encoder")
        encoder.transform(rows, ["case_id"]).write.parquet(path + "/rows")

    path = publish(spark, scratch_path(spark, f"models/{key}/encoded-rows"), write)["path"]
    return Encoder(PipelineModel.load(path + "/encoder"), features), spark.read.parquet(path + "/rows")


def fitted(spec: M.Spec, train: DataFrame, features: list[str], key: str | None = None) -> M.Fitted:
    """Load the saved fit of `spec`, or fit on all training rows and publish it."""
    spark = train.sparkSession
    key = key or training_key(train, features)
    encoder, rows = encoded_rows(train, features, key)

    def write(path: str) -> None:
        M.save_model(M.fit_encoded(spec, rows, encoder), path + "/model", spark)

    path = publish(spark, scratch_path(spark, f"models/{key}/{spec.config}-{_digest(spec.family, spec.params)}"), write)["path"]
    return M.load_model(spec, encoder, path + "/model", spark)


def scored_splits(splits: dict[str, DataFrame], specs: list[M.Spec], features: list[str], sets=(("valid", VALID), ("test", TEST)),
                  parallelism: int = 3) -> DataFrame:
    """(conjunto, modelo, configuracao, case_id, y, p) for every spec and split.

    Independent configurations are fitted as concurrent Spark jobs from the same
    encoded rows; each split is read and encoded once for all of them."""
    key = training_key(splits["train"], features)
    encoded_rows(splits["train"], features, key)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(specs)))) as pool:
        fits = list(pool.map(lambda sp: fitted(sp, splits["train"], features, key=key), specs))
    each = F.array(*[F.struct(F.lit(s.name).alias("modelo"), F.lit(s.config).alias("configuracao"), F.col(f"p{i}").alias("p"))
                     for i, s in enumerate(specs)])
    parts = [M.score_all(fits, splits[name], ["case_id"]).select(F.lit(label).alias("conjunto"), "case_id", "y", F.inline(each))
             for name, label in sets]
    return union_by_name(parts).select("conjunto", "modelo", "configuracao", "case_id", "y", "p")


def train_evaluate(splits: dict[str, DataFrame], features: list[str], specs: list[M.Spec] = FINAL_SPECS) -> DataFrame:
    """Metric rows (validation and test) of both baselines and every model."""
    models = scored_splits(splits, specs, features).drop("configuracao")
    base = baseline_scores(splits)
    return metric_rows(union_by_name([base, models]))


def predictions(splits: dict[str, DataFrame], features: list[str], spec: M.Spec) -> DataFrame:
    """Test predictions of one model at its validation threshold:
    modelo, case_id, y_true, y_proba, y_pred."""
    model = fitted(spec, splits["train"], features)
    counts = score_counts(M.score(model, splits["valid"], ["case_id"]))
    t = best_threshold(sweep(counts)).first()["threshold"]
    return M.score(model, splits["test"], ["case_id"]).select(
        F.lit(spec.name).alias("modelo"), "case_id", F.col("y").alias("y_true"), F.col("p").alias("y_proba"),
        (F.col("p") >= F.lit(t)).cast("int").alias("y_pred"))


def tuning_models(splits: dict[str, DataFrame], features: list[str], specs: list[M.Spec] = TUNING_SPECS) -> DataFrame:
    """Grid of fitted configurations evaluated on validation (threshold from validation)."""
    from .tuning import grid_results
    scored = scored_splits(splits, specs, features, sets=(("valid", VALID),))
    fam = F.create_map(*[x for s in specs for x in (F.lit(s.config), F.lit(FAMILY_LABEL[s.family]))])
    par = F.create_map(*[x for s in specs for x in (F.lit(s.config), F.lit(str(s.params)))])
    return grid_results(scored.select("modelo", fam[F.col("configuracao")].alias("familia"), "configuracao",
                                      par[F.col("configuracao")].alias("params"), "case_id", "y", "p"))
