"""Score newly arrived cases with the published final model.

A file stream over cleaned parts hands each micro-batch to the model that the
marker names. Scores of batch b go to `<out>/lote=<b>`, which a replayed batch
overwrites, so a retry after the loss of the driver or an executor neither loses
nor repeats a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import modelling_set
from ..plans.final import Final

SCORES = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("modelo", T.StringType()),
                       T.StructField("y_proba", T.DoubleType()), T.StructField("y_pred", T.IntegerType())])


def score_batch(final: Final, cases: DataFrame, out: str, batch: int, years: tuple[int, int]) -> None:
    """Write one batch's scores of the cases closed in `years`."""
    rows = modelling_set(cases, *years, features=final.features)
    scored = final.score(rows, ["case_id"]).select(
        "case_id", F.lit(final.modelo).alias("modelo"), F.col("p").alias("y_proba"), (F.col("p") >= final.threshold).cast("int").alias("y_pred"))
    scored.write.mode("overwrite").parquet(f"{out}/lote={batch}")


def run_scoring(spark: SparkSession, final: Final, parts: str, schema: T.StructType, out: str, checkpoint: str, years: tuple[int, int],
                files_per_batch: int = 64) -> DataFrame:
    """Score every cleaned part file that has not been scored yet; gives all scores."""
    cases = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(parts)
    query = (cases.writeStream.foreachBatch(lambda rows, batch: score_batch(final, rows, out, batch, years))
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(SCORES).option("basePath", out).parquet(out).select(*SCORES.names)
