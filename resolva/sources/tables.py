"""Readers for the shared parquet tables and the derived complaint-case view.

Timestamps in the shared tables are `timestamp_ntz`; they are cast once here
so every later expression sees plain timestamps (session time zone is UTC).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one shared table; `timestamp_ntz` columns become `timestamp`."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = [F.col(f.name).cast("timestamp").alias(f.name)
             if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
             for f in df.schema.fields]
    return df.select(*casts)


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One messy complaint case per order (spelling, blanks, date formats vary).

    Mirrors the shape of a raw complaint export: untrimmed and upper-cased
    status text, missing problem groups and opening years, dates in ISO and
    day-first form, and impossible dates. Every column is a string, as it
    would be after a CSV read with an all-string schema.

    Plan: orders ⋈ customer is the only large join (hash-shuffled on the
    customer key; AQE turns it into a broadcast when customer is small);
    nation/region are fixed-size dimension tables the planner broadcasts by
    its size estimate.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    yy = F.year(d).cast("string")
    mm = F.lpad(F.month(d).cast("string"), 2, "0")
    dd = F.lpad(F.dayofmonth(d).cast("string"), 2, "0")
    return j.select(
        k.alias("case_id"),
        F.concat(F.lit("reclamacoes_"), yy, F.lit("_"), mm, F.lit(".csv")).alias("source_file"),
        F.when(k % 2 == 0, F.lit("Internet")).otherwise(F.lit(" Aplicativo ")).alias("canal_de_origem"),
        F.col("r_name").alias("regiao"),
        F.col("n_name").alias("uf"),
        F.col("c_mktsegment").alias("segmento_de_mercado"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("grupo_problema"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("F")).when(F.col("c_custkey") % 3 == 1, F.lit(" M ")).alias("sexo"),
        F.when(F.col("c_acctbal") < 0, F.lit("até 20 anos")).when(F.col("c_acctbal") < 2500, F.lit("entre 21 a 30 anos"))
         .when(F.col("c_acctbal") < 5000, F.lit("entre 31 a 40 anos")).when(F.col("c_acctbal") < 7500, F.lit("entre 41 a 50 anos"))
         .otherwise(F.lit("mais de 50 anos")).alias("faixa_etaria"),
        F.month(d).cast("string").alias("mes_abertura"),
        F.concat(F.lit("Área "), F.col("c_mktsegment")).alias("area"),
        F.concat(F.col("o_orderpriority"), F.lit(" - "), F.col("r_name")).alias("assunto"),
        F.concat(F.lit("Problema "), (F.col("c_custkey") % 40).cast("string")).alias("problema"),
        F.when(k % 4 == 0, F.lit("Internet")).when(k % 4 == 1, F.lit("Loja física")).when(k % 4 == 2, F.lit("Telefone "))
         .alias("como_comprou_contratou"),
        F.when(F.col("o_totalprice") >= 200000, F.lit("S")).otherwise(F.lit("N")).alias("procurou_empresa"),
        F.when(F.year(d) == 1995, F.lit(None).cast("string")).otherwise(yy).alias("ano_abertura"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Finalizada não avaliada"))
         .when(k % 3 == 0, F.lit(" FINALIZADA AVALIADA"))
         .otherwise(F.lit("Finalizada avaliada")).alias("situacao"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" Resolvida "))
         .when(F.col("o_orderstatus") == "O", F.lit("Não Resolvida"))
         .otherwise(F.lit("Não Avaliada")).alias("avaliacao_reclamacao"),
        F.when(k % 50 == 0, F.lit("31/02/1999"))
         .when(k % 2 == 0, F.concat_ws("-", yy, mm, dd))
         .otherwise(F.concat_ws("/", dd, mm, yy)).alias("data_finalizacao"),
    )


# SQL twin of `raw_cases` for the DuckDB oracle (same text runs in Spark SQL).
RAW_CASES_SQL = """
SELECT o.o_orderkey AS case_id,
       'reclamacoes_' || CAST(year(o.o_orderdate) AS VARCHAR) || '_' || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0') || '.csv' AS source_file,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'Internet' ELSE ' Aplicativo ' END AS canal_de_origem,
       r.r_name AS regiao, n.n_name AS uf, c.c_mktsegment AS segmento_de_mercado,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS grupo_problema,
       CASE c.c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN ' M ' END AS sexo,
       CASE WHEN c.c_acctbal < 0 THEN 'até 20 anos' WHEN c.c_acctbal < 2500 THEN 'entre 21 a 30 anos'
            WHEN c.c_acctbal < 5000 THEN 'entre 31 a 40 anos' WHEN c.c_acctbal < 7500 THEN 'entre 41 a 50 anos'
            ELSE 'mais de 50 anos' END AS faixa_etaria,
       CAST(month(o.o_orderdate) AS VARCHAR) AS mes_abertura, 'Área ' || c.c_mktsegment AS area,
       o.o_orderpriority || ' - ' || r.r_name AS assunto, 'Problema ' || CAST(c.c_custkey % 40 AS VARCHAR) AS problema,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'Internet' WHEN 1 THEN 'Loja física' WHEN 2 THEN 'Telefone ' END AS como_comprou_contratou,
       CASE WHEN o.o_totalprice >= 200000 THEN 'S' ELSE 'N' END AS procurou_empresa,
       CASE WHEN year(o.o_orderdate) = 1995 THEN NULL ELSE CAST(year(o.o_orderdate) AS VARCHAR) END AS ano_abertura,
       CASE WHEN o.o_orderstatus = 'P' THEN 'Finalizada não avaliada'
            WHEN o.o_orderkey % 3 = 0 THEN ' FINALIZADA AVALIADA' ELSE 'Finalizada avaliada' END AS situacao,
       CASE o.o_orderstatus WHEN 'F' THEN ' Resolvida ' WHEN 'O' THEN 'Não Resolvida' ELSE 'Não Avaliada' END AS avaliacao_reclamacao,
       CASE WHEN o.o_orderkey % 50 = 0 THEN '31/02/1999'
            WHEN o.o_orderkey % 2 = 0 THEN CAST(year(o.o_orderdate) AS VARCHAR) || '-' || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(o.o_orderdate) AS VARCHAR), 2, '0')
            ELSE lpad(CAST(day(o.o_orderdate) AS VARCHAR), 2, '0') || '/' || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0') || '/' || CAST(year(o.o_orderdate) AS VARCHAR) END AS data_finalizacao
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union parts by column name; a column missing from a part becomes NULL.

    Parts are expected to agree on types (callers cast to string at the
    boundary); Spark would otherwise silently pick one side's type.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
