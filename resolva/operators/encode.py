"""Encode once, fit many.

The encoder (one `StringIndexer` over all features, alphabetical, unseen values
last) is fitted in one pass. Its encoded rows are written once and serve every
model family: `features` is the one-hot vector for `pyspark.ml` estimators and
`cells` the same row as the numbers of its set columns, one per feature in
feature order; a value without a column (unseen) has the number `width`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET


def encoder_stages(features: list[str]) -> list:
    idx = [f"{f}__idx" for f in features]
    ohe = [f"{f}__ohe" for f in features]
    return [
        StringIndexer(inputCols=features, outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
        VectorAssembler(inputCols=ohe, outputCol="features"),
    ]


@dataclass
class Encoder:
    """A fitted encoder and the columns it makes."""
    pipeline: PipelineModel
    features: list[str]

    def __post_init__(self):
        self.labels = [list(x) for x in self.pipeline.stages[0].labelsArray]
        sizes = [len(x) for x in self.labels]
        self.width = sum(sizes)
        self.starts = [sum(sizes[:i]) for i in range(len(sizes))]

    def cells(self) -> Column:
        """Column numbers of a row that the pipeline has indexed."""
        one = [F.when(F.col(f"{f}__idx") < len(labels), F.col(f"{f}__idx").cast("int") + start).otherwise(self.width)
               for f, labels, start in zip(self.features, self.labels, self.starts)]
        return F.array(*one)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(keep…, target, cells, features)"""
        out = self.pipeline.transform(df)
        return out.select(*keep, F.col(TARGET).cast("int").alias(TARGET), self.cells().alias("cells"), "features")

    def names(self) -> list[tuple[str, str]]:
        """(variable, category) of every column."""
        return [(f, x) for f, labels in zip(self.features, self.labels) for x in labels]


def fit_encoder(train: DataFrame, features: list[str]) -> Encoder:
    return Encoder(Pipeline(stages=encoder_stages(features)).fit(train), features)
