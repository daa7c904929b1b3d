"""Report tables over metric rows and model weights.

Inputs here are small (one row per model/configuration, or one row per
encoded feature), but everything stays a DataFrame so it composes with the
jobs that produce them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten
from ..schema import FEATURE_ABBREV

CONFUSION_CELLS = {
    "tn": "tn_nao_resolvida",
    "fp": "fp_nao_resolvida_classificada_como_resolvida",
    "fn": "fn_resolvida_classificada_como_nao_resolvida",
    "tp": "tp_resolvida",
}
UNKNOWN_VARIABLE = "variavel_desconhecida"


def confusion_cells(metrics: DataFrame) -> DataFrame:
    """Four confusion cells per (conjunto, modelo) with their share of the total (%, 1 place)."""
    long = metrics.select("conjunto", "modelo", *[F.col(c).alias(k) for k, c in CONFUSION_CELLS.items()]) \
                  .unpivot(["conjunto", "modelo"], list(CONFUSION_CELLS), "celula", "quantidade")
    w = Window.partitionBy("conjunto", "modelo")
    return long.select("conjunto", "modelo", "celula", "quantidade",
                       F.round(100.0 * F.col("quantidade") / F.sum("quantidade").over(w), 1).alias("percentual"))


def best_config(results: DataFrame, by_probability: bool = False) -> DataFrame:
    """Best configuration per model: macro-F1 desc, or Brier asc then log loss asc.

    Ties fall to the configuration name so the choice is total.
    """
    order = ([F.asc("brier_score"), F.asc("log_loss")] if by_probability else [F.desc("f1_macro")])
    w = Window.partitionBy("modelo").orderBy(*order, F.asc("configuracao"))
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def leaderboard(metrics: DataFrame, metric: str = "f1_macro", lower_is_better: bool = False) -> DataFrame:
    """Models ranked by one metric (direction by metric), with display names."""
    order = F.asc(metric) if lower_is_better else F.desc(metric)
    w = Window.orderBy(order, F.asc("modelo"))
    return metrics.select(F.row_number().over(w).alias("posicao"), F.col("modelo").alias("Modelo"),
                          F.col(metric).alias("valor"),
                          F.col("f1_macro").alias("F1 macro"), F.col("roc_auc").alias("ROC-AUC"),
                          F.col("brier_score").alias("Brier"), F.col("log_loss").alias("Log loss"))


def best_model(metrics: DataFrame, exclude_prefix: str = "Baseline") -> DataFrame:
    """Best non-baseline model by macro-F1 and by probability quality (Brier, log loss)."""
    cand = metrics.filter(~F.col("modelo").startswith(exclude_prefix))
    by_f1 = cand.orderBy(F.desc("f1_macro"), F.asc("modelo")).limit(1) \
                .select(F.lit("classificacao").alias("criterio"), "modelo", "f1_macro", "brier_score", "log_loss")
    by_prob = cand.orderBy(F.asc("brier_score"), F.asc("log_loss"), F.asc("modelo")).limit(1) \
                  .select(F.lit("probabilidade").alias("criterio"), "modelo", "f1_macro", "brier_score", "log_loss")
    return by_f1.unionByName(by_prob)


def feature_label(variable, category):
    """'<short variable>: <category>' with the abbreviation map (fallback: name)."""
    abbrev = F.create_map(*[x for k, v in FEATURE_ABBREV.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.coalesce(abbrev[variable], variable), F.lit(": "), category)


def split_encoded_name(encoded, variables: list[str]):
    """(variable, category) of '[cat__]<variable>_<category>'. The first declared
    variable that fits wins; a name without one is a category of the unknown
    variable."""
    name = F.replace(encoded, F.lit("cat__"), F.lit(""))
    var = F.lit(None).cast("string")
    for v in reversed(variables):
        var = F.when(F.startswith(name, F.lit(v + "_")), F.lit(v)).otherwise(var)
    cat = F.when(var.isNull(), name).otherwise(name.substr(F.length(var) + 2, F.length(name)))
    return F.coalesce(var, F.lit(UNKNOWN_VARIABLE)), cat


def encoded_coefficients(weights: DataFrame, variables: list[str], name: str = "feature_codificada") -> DataFrame:
    """Coefficient table of foreign weights that only have an encoded name."""
    var, cat = split_encoded_name(F.col(name), variables)
    return weights.select(name, "coeficiente", var.alias("variavel"), cat.alias("categoria"), feature_label(var, cat).alias("label_grafico"),
                          F.abs("coeficiente").alias("abs_coeficiente"), F.exp("coeficiente").alias("odds_ratio"))


def coefficient_table(weights: DataFrame) -> DataFrame:
    """(variavel, categoria, coeficiente) → + feature name, label, |coef|, odds ratio."""
    return weights.select(
        F.concat_ws("_", "variavel", "categoria").alias("feature_codificada"),
        "coeficiente", "variavel", "categoria",
        feature_label(F.col("variavel"), F.col("categoria")).alias("label_grafico"),
        F.abs("coeficiente").alias("abs_coeficiente"),
        F.exp("coeficiente").alias("odds_ratio"))


def coefficient_top(coefs: DataFrame, n: int = 30, increasing: bool = True) -> DataFrame:
    order = F.desc("coeficiente") if increasing else F.asc("coeficiente")
    return coefs.orderBy(order, F.asc("feature_codificada")).limit(n)


def coefficient_summary(coefs: DataFrame) -> DataFrame:
    return (coefs.groupBy("variavel")
                 .agg(F.avg("abs_coeficiente").alias("media_abs_coeficiente"),
                      F.max("abs_coeficiente").alias("max_abs_coeficiente"),
                      F.count("categoria").alias("quantidade_categorias")))


def importance_table(weights: DataFrame) -> DataFrame:
    """(variavel, categoria, importancia) → + feature name and label."""
    return weights.select(
        F.concat_ws("_", "variavel", "categoria").alias("feature_codificada"), "importancia",
        "variavel", "categoria", feature_label(F.col("variavel"), F.col("categoria")).alias("label_grafico"))


def importance_top(imps: DataFrame, n: int = 50) -> DataFrame:
    return imps.orderBy(F.desc("importancia"), F.asc("feature_codificada")).limit(n)


def importance_summary(imps: DataFrame) -> DataFrame:
    return (imps.groupBy("variavel")
                .agg(F.sum("importancia").alias("importancia_total"),
                     F.avg("importancia").alias("importancia_media"),
                     F.count("categoria").alias("quantidade_categorias")))


def chart_slice(table: DataFrame, value: str, label: str, n: int = 10, width: int = 70) -> DataFrame:
    """Top-n rows of a ranked table with shortened labels, re-sorted ascending
    by the magnitude of `value` (bar-chart order)."""
    top = table.orderBy(F.desc(F.abs(F.col(value))), F.asc(label)).limit(n)
    return (top.select(shorten(F.col(label), width).alias("label_plot"),
                       F.abs(F.col(value)).alias("valor_plot"))
               .orderBy(F.asc("valor_plot"), F.asc("label_plot")))


def model_row(metrics: DataFrame, model: str, split: str | None = None) -> DataFrame:
    """Metric row(s) of one model; raises when the model is absent."""
    rows = metrics.filter(F.col("modelo") == model)
    if split is not None:
        rows = rows.filter(F.col("conjunto") == split)
    if rows.limit(1).count() == 0:
        raise LookupError(f"model not found: {model}")
    return rows


def numeric_metric(df: DataFrame, column: str, model_col: str = "modelo",
                   extra: list[str] | None = None) -> DataFrame:
    """(model, extra…, value) with the metric coerced to double; unparsable rows dropped."""
    return (df.select(F.col(model_col).alias("modelo"), *(extra or []),
                      F.expr(f"try_cast(`{column}` AS DOUBLE)").alias("valor"))
              .na.drop(subset=["valor"]))


def write_result_csv(df: DataFrame, path: str) -> None:
    """Small result table → one CSV with header (result tables are a few rows)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
