"""Profiling queries over the cleaned base.

Every aggregate here is a hash aggregate with a map-side partial step, so the
shuffle carries one row per (task, group), never raw rows. Top-k results use
`orderBy(...).limit(k)` which Spark plans as TakeOrderedAndProject (each task
keeps k rows). Ties are broken on the group value so results are total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SENTINEL, blank_to_sentinel
from ..schema import CLOSE_YEAR, TARGET


def total_rows(base: DataFrame) -> DataFrame:
    return base.agg(F.count(F.lit(1)).alias("total"))


def class_distribution(base: DataFrame) -> DataFrame:
    """Count and share (%) per target value; share via SUM(COUNT(*)) OVER ().

    The window runs on the aggregated rows (one per class), so its single
    partition holds two rows whatever the input size.
    """
    agg = (base.filter(F.col(TARGET).isNotNull())
               .groupBy(TARGET).agg(F.count(F.lit(1)).alias("quantidade")))
    share = 100.0 * F.col("quantidade") / F.sum("quantidade").over(Window.partitionBy())
    return (agg.select(TARGET, "quantidade", F.round(share, 2).alias("percentual"))
               .orderBy(TARGET))


def rate_by_year(base: DataFrame) -> DataFrame:
    return (base.filter(F.col(CLOSE_YEAR).isNotNull())
                .groupBy(CLOSE_YEAR)
                .agg(F.count(F.lit(1)).alias("quantidade"),
                     F.round(F.avg(TARGET), 4).alias("taxa_resolucao"))
                .orderBy(CLOSE_YEAR))


def top_groups(base: DataFrame, column: str, alias: str, n: int = 20) -> DataFrame:
    """Count and resolution rate per value (NULL → sentinel), top n by count."""
    return (base.filter(F.col(CLOSE_YEAR).isNotNull())
                .groupBy(F.coalesce(F.col(column), F.lit(SENTINEL)).alias(alias))
                .agg(F.count(F.lit(1)).alias("quantidade"),
                     F.round(F.avg(TARGET), 4).alias("taxa_resolucao"))
                .orderBy(F.desc("quantidade"), F.asc(alias))
                .limit(n))


def value_counts(base: DataFrame, column: str, n: int) -> DataFrame:
    """Top-n frequency table of one field, then re-sorted ascending by count."""
    top = (base.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(SENTINEL)).alias("valor"))
               .agg(F.count(F.lit(1)).alias("quantidade"))
               .orderBy(F.desc("quantidade"), F.asc("valor"))
               .limit(n))
    return top.orderBy(F.asc("quantidade"), F.desc("valor"))


def _long_form(base: DataFrame, fields: list[str]) -> DataFrame:
    """(campo, valor) rows for the given fields; blank/NULL → sentinel."""
    stacked = base.select(*[blank_to_sentinel(F.col(f).cast("string")).alias(f) for f in fields])
    return stacked.unpivot([], fields, "campo", "valor")


def domain_values(base: DataFrame, fields: list[str]) -> DataFrame:
    """Sorted distinct values per field, with the sentinel added when absent.

    Output `(campo, valor, adicionado)` in list order: per field the added
    sentinel first (adicionado = 1), then the observed values ascending. The
    order comes from one global range-partitioned sort, so no field is
    gathered into a single task.
    """
    seen = _long_form(base, fields).distinct()
    spark = base.sparkSession
    sentinel = spark.createDataFrame([(f, SENTINEL) for f in fields], "campo string, valor string")
    added = sentinel.join(seen, ["campo", "valor"], "left_anti").withColumn("adicionado", F.lit(1))
    allv = seen.withColumn("adicionado", F.lit(0)).unionByName(added)
    return allv.orderBy("campo", F.desc("adicionado"), "valor")


def top_k_per_group(df: DataFrame, groups: list[str], order: list, k: int, tie: str,
                    salt_buckets: int = 64) -> DataFrame:
    """Exact top-k rows per group without one task per group.

    Stage 1 ranks inside (group, hash(tie) % salt_buckets) sub-groups and
    keeps k per sub-group; the true top-k of a group is among those
    survivors. Stage 2 ranks at most k·salt_buckets rows per group.
    """
    salt = F.pmod(F.xxhash64(F.col(tie)), F.lit(salt_buckets))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order, F.asc(tie))
    w2 = Window.partitionBy(*groups).orderBy(*order, F.asc(tie))
    stage1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
                .filter(F.col("_r1") <= k).drop("_salt", "_r1"))
    return stage1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def top_values_per_field(base: DataFrame, fields: list[str], n: int = 60) -> DataFrame:
    """Top-n most frequent values per field (ties by value).

    One aggregation over the long form (partial aggregation absorbs hot
    values), then an exact two-stage per-field top-n.
    """
    counts = _long_form(base, fields).groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("quantidade"))
    return (top_k_per_group(counts, ["campo"], [F.desc("quantidade")], n, "valor")
            .select("campo", "valor", "quantidade", "rank"))


def processing_catalog(cases_raw_with_clean: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per-source-file ingest log: rows read, rows kept, class counts, years.

    `raw` carries every row read (with `source_file`), `clean` the kept rows.
    Two grouped aggregates joined on the file name (one row per file each).
    """
    raw, clean = cases_raw_with_clean
    read = raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("linhas_lidas"))
    kept = clean.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("linhas_filtradas"),
        F.sum(TARGET).cast("long").alias("resolvidas"),
        F.count_if(F.col(TARGET) == 0).cast("long").alias("nao_resolvidas"),
        F.min(CLOSE_YEAR).alias("ano_min"),
        F.max(CLOSE_YEAR).alias("ano_max"))
    j = read.join(kept, "source_file", "left")
    return j.select(
        F.col("source_file").alias("arquivo"),
        F.when(F.coalesce(F.col("linhas_filtradas"), F.lit(0)) == 0, F.lit("sem_dados_filtrados"))
         .otherwise(F.lit("ok")).alias("status"),
        "linhas_lidas",
        F.coalesce(F.col("linhas_filtradas"), F.lit(0)).cast("long").alias("linhas_filtradas"),
        "resolvidas", "nao_resolvidas", "ano_min", "ano_max")


def catalog_status(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("status").agg(F.count(F.lit(1)).alias("quantidade"))


# Portable SQL names of the Spark types used by the data model.
SQL_TYPE_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                  "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def describe_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """DESCRIBE: one row per column (name, SQL type name, nullable), taken from
    the types of the table's own rows."""
    names = F.create_map(*[F.lit(x) for pair in SQL_TYPE_NAMES.items() for x in pair])
    found = df.agg(*[F.max(F.typeof(F.col(f.name))).alias(f.name) for f in df.schema.fields])
    described = found.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("kind"), F.lit(f.nullable).alias("nullable"))
        for f in df.schema.fields])).alias("c"))
    return described.select("c.column_name", F.coalesce(F.element_at(names, F.col("c.kind")), F.upper("c.kind")).alias("column_type"),
                            "c.nullable")


def file_inventory(base: DataFrame, limit: int = 10) -> DataFrame:
    """Distinct source files (sorted) with the total file count on every row."""
    files = base.select("source_file").distinct()
    total = files.agg(F.count(F.lit(1)).alias("total_arquivos")).withColumn("one", F.lit(1))
    first = files.orderBy("source_file").limit(limit).withColumn("one", F.lit(1))
    return first.join(total, "one").select("source_file", "total_arquivos").orderBy("source_file")
