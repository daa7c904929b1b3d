"""Probability models on encoded rows (distributed fitting, no driver data).

Logistic regression and trees are `pyspark.ml` estimators; boosting
(`boosting.py`) and the calibrated linear SVM (`svm.py`) are second-order fits
that `pyspark.ml` does not have. All of them take the rows that one encoder
wrote (`encode.py`): every training category has a column, an unseen category
is the all-zeros vector. Balanced class weights n / (2·n_c) enter as
`weightCol`; since they sum to n, an L2 penalty C maps to regParam = 1 / (C·n).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TARGET
from . import boosting, svm
from .baselines import class_weights
from .encode import Encoder, fit_encoder

SEED = 42
WEIGHT = "peso"

# Model display names.
LOGREG = "Regressão Logística"
TREE = "Árvore de Decisão"
GBT = "Gradient Boosting"
SVM = "SVM Linear calibrado"


def with_class_weights(train: DataFrame, with_n: bool = False):
    """Join the 2-row balanced weight table (bounded by the class count).

    With `with_n`, also return the row count read from that same table
    (2 rows to the driver) instead of a separate counting pass.
    """
    w = class_weights(train)
    weighted = train.join(F.broadcast(w.select(TARGET, F.col("peso").alias(WEIGHT))), TARGET)
    if not with_n:
        return weighted
    n = sum(r["n_classe"] for r in w.select("n_classe").collect())
    return weighted, n


@dataclass
class Spec:
    """One model configuration."""
    name: str
    family: str
    config: str
    params: dict = field(default_factory=dict)


@dataclass
class Fitted:
    """A configuration's model and the encoder whose rows it takes."""
    spec: Spec
    encoder: Encoder
    model: Model | boosting.Booster | svm.CalibratedSVM


def fit_encoded(spec: Spec, rows: DataFrame, encoder: Encoder) -> Fitted:
    """Fit one configuration on encoded rows (case_id, target, cells, features)."""
    p = spec.params
    if spec.family == "gbt":
        model = boosting.fit(rows, encoder.width, rounds=p.get("n_estimators", 250), depth=p.get("max_depth", 6),
                             rate=p.get("learning_rate", 0.08), floor=p.get("min_child_weight", 3),
                             row_share=p.get("subsample", 0.8), column_share=p.get("colsample", 0.8), seed=SEED)
    elif spec.family == "svm":
        model = svm.fit_calibrated(rows, encoder, p.get("C", 0.1), seed=SEED, max_iter=p.get("max_iter", 3000))
    else:
        weighted, n = with_class_weights(rows, with_n=True)
        model = _estimator(spec, n).fit(weighted)
    return Fitted(spec, encoder, model)


def _estimator(spec: Spec, n: int):
    p = spec.params
    if spec.family == "logreg":
        return LogisticRegression(featuresCol="features", labelCol=TARGET, weightCol=WEIGHT,
                                  regParam=1.0 / (p.get("C", 0.1) * n), elasticNetParam=0.0,
                                  standardization=False, maxIter=p.get("max_iter", 400), tol=1e-4)
    if spec.family == "tree":
        return DecisionTreeClassifier(featuresCol="features", labelCol=TARGET, weightCol=WEIGHT,
                                      maxDepth=p.get("max_depth", 20),  # the estimator refuses more than 30
                                      minInstancesPerNode=p.get("min_samples_leaf", 500),
                                      impurity="gini", seed=SEED, maxBins=64)
    raise ValueError(spec.family)


def fit(spec: Spec, train: DataFrame, features: list[str]) -> Fitted:
    """Encode the training rows and fit one configuration on them."""
    encoder = fit_encoder(train, features)
    rows = encoder.transform(train, ["case_id"]).persist()
    try:
        return fit_encoded(spec, rows, encoder)
    finally:
        rows.unpersist()


def score_all(fits: list[Fitted], df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, y, p0, p1, …): the positive probability of every fit, which share
    one encoder; the rows are read and encoded once."""
    encoder = fits[0].encoder
    out = encoder.transform(df, list(dict.fromkeys(c for c in keep if c != TARGET)))
    for i, fit_ in enumerate(fits):
        if isinstance(fit_.model, boosting.Booster):
            out = out.withColumn(f"p{i}", fit_.model.probability(df.sparkSession))
        elif isinstance(fit_.model, svm.CalibratedSVM):
            out = out.withColumn(f"p{i}", fit_.model.probability(encoder))
        else:
            m = fit_.model
            out = m.transform(out, {m.probabilityCol: "_probability", m.rawPredictionCol: "_raw", m.predictionCol: "_prediction"})
            out = out.withColumn(f"p{i}", vector_to_array(F.col("_probability"))[1]).drop("_probability", "_raw", "_prediction")
    return out.select(*keep, F.col(TARGET).alias("y"), *[f"p{i}" for i in range(len(fits))])


def score(fitted: Fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, y, p) with p = positive-class probability."""
    return score_all([fitted], df, keep).withColumnRenamed("p0", "p")


# ----------------------------------------------------------------- saved fits
def save_model(fitted: Fitted, path: str, spark: SparkSession) -> None:
    if isinstance(fitted.model, (boosting.Booster, svm.CalibratedSVM)):
        spark.createDataFrame([(fitted.model.to_json(),)], "model string").coalesce(1).write.text(path)
    else:
        fitted.model.write().save(path)


def load_model(spec: Spec, encoder: Encoder, path: str, spark: SparkSession) -> Fitted:
    if spec.family in ("gbt", "svm"):
        text = spark.read.text(path, wholetext=True).first()[0]
        model = (boosting.Booster if spec.family == "gbt" else svm.CalibratedSVM).from_json(text)
    else:
        model = (LogisticRegressionModel if spec.family == "logreg" else DecisionTreeClassificationModel).load(path)
    return Fitted(spec, encoder, model)


# ------------------------------------------------------ interpretation tables
def encoded_weights(encoder: Encoder, values, name: str) -> DataFrame:
    """(variavel, categoria, value) for each column of an encoder. Its names give
    the variable and category, so no encoded name is parsed. As many rows as the
    model has columns, built on the driver from the model."""
    rows = [(f, x, float(v)) for (f, x), v in zip(encoder.names(), values)]
    return SparkSession.getActiveSession().createDataFrame(rows, f"variavel string, categoria string, {name} double")


def coefficient_weights(fitted: Fitted) -> DataFrame:
    return encoded_weights(fitted.encoder, fitted.model.coefficients.toArray(), "coeficiente")


def importance_weights(fitted: Fitted) -> DataFrame:
    """A tree's impurity shares, or boosting's mean gain shares."""
    m = fitted.model
    return encoded_weights(fitted.encoder, m.gains() if isinstance(m, boosting.Booster) else m.featureImportances.toArray(), "importancia")
