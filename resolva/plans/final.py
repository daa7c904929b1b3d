"""The final model: chosen on validation, published with its predictions.

All candidates of a family are scored on validation and test and evaluated from
one table of score counts. The best by probability (Brier score, then log loss)
is published as one version (`sources/publish.py`): the model, the metric rows
of all candidates and its test predictions, with the feature list, threshold
and key in the marker. The key is made of the rows' values, the split years,
the features and the family's description, so a later session over the same
rows loads the version, and other rows, years or candidates make another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import as_lookup, round_doubles
from ..operators import baselines as bl
from ..operators import models as M
from ..operators.splits import SplitSpec, labelled_splits
from ..schema import TARGET
from ..session import scratch_path
from ..sources.publish import publish, rows_fingerprint
from ..sources.tables import union_by_name
from . import training as TR
from .evaluation import TEST, VALID, metric_rows
from .tuning import RATE_GRID, rate_scores, rate_tables, _gid

KEYS = ("modelo", "configuracao")
Scorer = Callable[[DataFrame, list[str]], DataFrame]


@dataclass
class RateFamily:
    """Target-mean models by one or two fields."""
    grid: list = None

    def __post_init__(self):
        self.grid = self.grid or RATE_GRID

    def describe(self) -> list:
        return ["rates", [[m, c, cols] for m, c, cols in self.grid]]

    def scores(self, splits: dict[str, DataFrame], features: list[str]) -> DataFrame:
        parts = [rate_scores(splits["train"], splits[name], self.grid).withColumn("conjunto", F.lit(label))
                 for name, label in (("valid", VALID), ("test", TEST))]
        return union_by_name(parts).select("conjunto", *KEYS, "case_id", "y", "p")

    def save(self, best: Row, splits: dict[str, DataFrame], features: list[str], path: str) -> dict:
        columns = next(cols for _, config, cols in self.grid if config == best["configuracao"])
        every = sorted({c for _, _, cols in self.grid for c in cols})
        rates = rate_tables(splits["train"], self.grid).filter(F.col("_gid") == _gid(every, columns))
        rates.select(*columns, "taxa_grupo").write.parquet(path)
        return {"columns": columns, "general": bl.global_rate(splits["train"])}

    @staticmethod
    def load(spark: SparkSession, path: str, marker: dict) -> Scorer:
        def score(df: DataFrame, keep: list[str]) -> DataFrame:
            joined = df.join(as_lookup(spark.read.parquet(path)), marker["columns"], "left")
            return joined.select(*keep, F.col(TARGET).cast("int").alias("y"), F.coalesce("taxa_grupo", F.lit(marker["general"])).alias("p"))
        return score


@dataclass
class ModelFamily:
    """Fitted models (`training.py`)."""
    specs: list[M.Spec] = None

    def __post_init__(self):
        self.specs = self.specs or TR.FINAL_SPECS

    def describe(self) -> list:
        return ["models", [asdict(s) for s in self.specs]]

    def scores(self, splits: dict[str, DataFrame], features: list[str]) -> DataFrame:
        return TR.scored_splits(splits, self.specs, features)

    def save(self, best: Row, splits: dict[str, DataFrame], features: list[str], path: str) -> dict:
        spec = next(s for s in self.specs if s.config == best["configuracao"])
        fit = TR.fitted(spec, splits["train"], features)
        fit.encoder.pipeline.write().save(path + "/encoder")
        M.save_model(fit, path + "/model", splits["train"].sparkSession)
        return {"spec": asdict(spec)}

    @staticmethod
    def load(spark: SparkSession, path: str, marker: dict) -> Scorer:
        encoder = TR.Encoder(TR.PipelineModel.load(path + "/encoder"), marker["features"])
        fit = M.load_model(M.Spec(**marker["spec"]), encoder, path + "/model", spark)
        return lambda df, keep: M.score(fit, df, keep)


FAMILIES = {"rates": RateFamily, "models": ModelFamily}


@dataclass
class Final:
    """A published final model."""
    marker: dict
    features: list[str]
    modelo: str
    configuracao: str
    threshold: float
    score: Scorer                 # (cases, columns to keep) → keep…, y, p
    predictions: DataFrame        # modelo, configuracao, case_id, y_true, y_proba, y_pred of the test set
    metrics: DataFrame            # metric rows of every candidate on validation and test


def load(spark: SparkSession, marker: dict) -> Final:
    path = marker["path"]
    return Final(marker, marker["features"], marker["modelo"], marker["configuracao"], marker["threshold"],
                 FAMILIES[marker["family"]].load(spark, path + "/model", marker),
                 spark.read.parquet(path + "/predictions"), spark.read.parquet(path + "/metrics"))


def best_by_probability(metrics: DataFrame, keys: tuple[str, ...] = KEYS) -> Row:
    """The candidate with the lowest Brier score on validation, then log loss,
    then name; baselines are not candidates. Scores count to nine places."""
    valid = round_doubles(metrics.filter((F.col("conjunto") == VALID) & ~F.startswith("modelo", F.lit(bl.BASELINE_PREFIX))))
    return valid.orderBy("brier_score", "log_loss", *keys).first()


def finalize(splits: dict[str, DataFrame], spec: SplitSpec, family: RateFamily | ModelFamily, features: list[str]) -> Final:
    """The published final model of these splits, chosen and published if it is not there yet."""
    spark = splits["train"].sparkSession
    parts = {"rows": rows_fingerprint(labelled_splits(splits), ["conjunto"]), "years": asdict(spec), "features": features,
             "family": family.describe(), "fitting": TR.FITTING}
    key = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]

    def write(path: str) -> dict:
        scored = family.scores(splits, features)
        metric_rows(scored, keys=KEYS).write.parquet(path + "/metrics")
        metrics = spark.read.parquet(path + "/metrics")
        best = best_by_probability(metrics)
        if best is None:
            raise ValueError("no candidate has validation rows")
        threshold = metrics.filter((F.col("conjunto") == VALID) & _is(best)).first()["threshold"]
        own = scored.filter((F.col("conjunto") == TEST) & _is(best))
        own.select(*KEYS, "case_id", F.col("y").alias("y_true"), F.col("p").alias("y_proba"),
                   (F.col("p") >= F.lit(threshold)).cast("int").alias("y_pred")).write.parquet(path + "/predictions")
        return {"modelo": best["modelo"], "configuracao": best["configuracao"], "threshold": threshold, "features": features,
                "family": family.describe()[0], "made_of": parts} | family.save(best, splits, features, path + "/model")

    return load(spark, publish(spark, scratch_path(spark, f"final/{key}"), write))


def _is(best: Row) -> Column:
    return (F.col("modelo") == best["modelo"]) & (F.col("configuracao") == best["configuracao"])
