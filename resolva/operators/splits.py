"""Temporal train / validation / test splits and the modelling projection."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_text
from ..schema import CLOSE_YEAR, FEATURES, TARGET
from ..session import scratch_path
from ..sources.publish import publish, rows_fingerprint
from ..sources.tables import union_by_name

# Split labels.
LABEL_TRAIN, LABEL_VALID, LABEL_TEST = "Treino", "Validação", "Teste"


@dataclass(frozen=True)
class SplitSpec:
    """Close-year ranges. Defaults fit the shared tables (orders 1995-2001);
    the original data used train 2014-2024, valid 2025, test 2026."""
    train_from: int = 1995
    train_to: int = 1999
    valid_year: int = 2000
    test_year: int = 2001


def modelling_set(clean: DataFrame, year_from: int, year_to: int,
                  features: list[str] = FEATURES, keep: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Rows closed in [year_from, year_to] with a known year and target.

    Features are strings with NULL → sentinel; a feature missing from the
    input is the sentinel everywhere. The year predicate is a plain range
    on `ano_finalizacao`, so a year-partitioned base is pruned at scan.
    """
    cols = [F.col(k) for k in keep if k in clean.columns]
    for f in features:
        src = F.col(f) if f in clean.columns else F.lit(None).cast("string")
        cols.append(feature_text(src).alias(f))
    cols.append(F.col(TARGET).cast("int").alias(TARGET))
    return (clean.filter(F.col(CLOSE_YEAR).between(year_from, year_to)
                         & F.col(CLOSE_YEAR).isNotNull() & F.col(TARGET).isNotNull())
                 .select(*cols))


def temporal_splits(clean: DataFrame, spec: SplitSpec = SplitSpec(),
                    features: list[str] = FEATURES) -> dict[str, DataFrame]:
    return {
        "train": modelling_set(clean, spec.train_from, spec.train_to, features),
        "valid": modelling_set(clean, spec.valid_year, spec.valid_year, features),
        "test": modelling_set(clean, spec.test_year, spec.test_year, features),
    }


def labelled_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Union of the three splits with a `conjunto` label column (by name)."""
    labels = {"train": LABEL_TRAIN, "valid": LABEL_VALID, "test": LABEL_TEST}
    return union_by_name([splits[k].withColumn("conjunto", F.lit(v)) for k, v in labels.items()])


def split_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, resolved, unresolved and the resolution rate (4 places)."""
    by = by or []
    return (df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum(TARGET).cast("long").alias("resolvidas"),
        (F.count(F.lit(1)) - F.sum(TARGET)).cast("long").alias("nao_resolvidas"),
        F.round(F.avg(TARGET), 4).alias("taxa_resolucao")))


def write_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """The three splits written as one published version, partitioned by split,
    and read back. The version's key is made of the rows' values."""
    whole = labelled_splits(splits)
    spark = whole.sparkSession
    key = hashlib.sha256(json.dumps(rows_fingerprint(whole, ["conjunto"])).encode()).hexdigest()[:24]

    def write(path: str) -> None:
        whole.write.partitionBy("conjunto").parquet(path)

    path = publish(spark, scratch_path(spark, f"splits/{key}"), write)["path"]
    return spark.read.schema(whole.schema).parquet(path)
