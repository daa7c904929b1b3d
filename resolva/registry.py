"""Registered queries over the shared tables, each with an independent SQL twin.

`QUERIES[name](spark, sf_dir) -> DataFrame` and `ORACLE[name] -> DuckDB SQL`.
Names without an `ORACLE` entry are checked on row counts only (model
fitting, file ingest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.dates import parse_mixed_date
from .functions.frames import round_doubles
from .functions.text import NA_TOKENS, blank_to_sentinel, normalize_value, null_na_tokens
from .operators import baselines as bl
from .operators import evaluate as ev
from .operators import profile as pr
from .operators.clean import clean_cases
from .operators.sampling import sample_fixed
from .operators.splits import SplitSpec, labelled_splits, split_summary, temporal_splits, write_splits
from .plans.evaluation import baseline_scores, choose_thresholds, metric_rows
from .schema import FEATURE_ABBREV, FEATURES
from .sources.base import base_path, cleaned_base
from .sources.publish import remove
from .sources.tables import raw_cases, read_table, union_by_name

SPEC = SplitSpec()
TRAIN_WHERE = f"ano_finalizacao BETWEEN {SPEC.train_from} AND {SPEC.train_to}"
VALID_WHERE = f"ano_finalizacao = {SPEC.valid_year}"
TEST_WHERE = f"ano_finalizacao = {SPEC.test_year}"
SAMPLE_N, SAMPLE_SEED = 5000, 42
RAW_TEXT_FIELDS = [*FEATURES, "situacao", "avaliacao_reclamacao"]

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned base (written once per input version, then read)."""
    return cleaned_base(spark, d)


def _splits(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return temporal_splits(_clean(spark, d), SPEC, FEATURES)


def _events_scored(spark: SparkSession, d: str) -> DataFrame:
    """Continuous, tie-heavy score: value/(value+50) against 'purchase'."""
    e = read_table(spark, d, "events")
    return e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"),
                    (F.col("value") / (F.col("value") + 50.0)).alias("p"))


EVENTS_SCORED_SQL = ("SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y, "
                     "value / (value + 50.0) AS p FROM events")


def _r9(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


# ------------------------------------------------------------------ cleaning
@query("clean_cases", O.with_ctes("SELECT * FROM clean_cases"))
def q_clean_cases(spark, d):
    return clean_cases(raw_cases(spark, d))


@query("normalize_values", O.with_ctes(
    "SELECT campo, valor, " + O.norm("valor") + " AS normalizado, count(*) AS quantidade FROM ("
    "SELECT 'situacao' AS campo, situacao AS valor FROM raw_cases UNION ALL "
    "SELECT 'avaliacao_reclamacao', avaliacao_reclamacao FROM raw_cases UNION ALL "
    "SELECT 'canal_de_origem', canal_de_origem FROM raw_cases) GROUP BY campo, valor"))
def q_normalize_values(spark, d):
    raw = raw_cases(spark, d).select("situacao", "avaliacao_reclamacao", "canal_de_origem")
    long = raw.unpivot([], ["situacao", "avaliacao_reclamacao", "canal_de_origem"], "campo", "valor")
    return (long.groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("quantidade"))
                .select("campo", "valor", normalize_value(F.col("valor")).alias("normalizado"), "quantidade"))


@query("mixed_dates", O.with_ctes(
    "SELECT case_id, data_finalizacao AS texto, close_ts AS data, CAST(year(close_ts) AS INTEGER) AS ano, "
    "CAST(month(close_ts) AS INTEGER) AS mes FROM (SELECT case_id, data_finalizacao, "
    + O._close_ts("data_finalizacao") + " AS close_ts FROM raw_cases)"))
def q_mixed_dates(spark, d):
    raw = raw_cases(spark, d)
    ts = parse_mixed_date(F.col("data_finalizacao"))
    return raw.select("case_id", F.col("data_finalizacao").alias("texto"), ts.alias("data"),
                      F.year(ts).cast("int").alias("ano"), F.month(ts).cast("int").alias("mes"))


_NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


@query("na_tokens", O.with_ctes(
    "SELECT campo, count(*) AS linhas, CAST(sum(CASE WHEN valor IS NULL OR valor IN (" + _NA_LIST
    + ") THEN 1 ELSE 0 END) AS BIGINT) AS nulos FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS campo, {c} AS valor FROM raw_cases" for c in RAW_TEXT_FIELDS) + ") GROUP BY campo"))
def q_na_tokens(spark, d):
    raw = raw_cases(spark, d).select(*RAW_TEXT_FIELDS)
    long = raw.unpivot([], RAW_TEXT_FIELDS, "campo", "valor")
    return long.groupBy("campo").agg(F.count(F.lit(1)).alias("linhas"),
                                     F.count_if(null_na_tokens(F.col("valor")).isNull()).alias("nulos"))


@query("blank_default", O.with_ctes(
    "SELECT campo, coalesce(nullif(trim(valor), ''), 'Não informado') AS valor, count(*) AS quantidade FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS campo, {c} AS valor FROM raw_cases" for c in RAW_TEXT_FIELDS)
    + ") GROUP BY 1, 2"))
def q_blank_default(spark, d):
    raw = raw_cases(spark, d).select(*RAW_TEXT_FIELDS)
    long = raw.unpivot([], RAW_TEXT_FIELDS, "campo", "valor")
    return (long.select("campo", blank_to_sentinel(F.col("valor")).alias("valor"))
                .groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("quantidade")))


# ----------------------------------------------------------------- profiling
@query("total_rows", O.with_ctes("SELECT count(*) AS total FROM clean_cases"))
def q_total_rows(spark, d):
    return pr.total_rows(_clean(spark, d))


@query("class_distribution", O.with_ctes(
    "SELECT target_resolvida, count(*) AS quantidade, "
    "round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percentual "
    "FROM clean_cases WHERE target_resolvida IS NOT NULL GROUP BY target_resolvida"))
def q_class_distribution(spark, d):
    return pr.class_distribution(_clean(spark, d))


@query("rate_by_year", O.with_ctes(
    "SELECT ano_finalizacao, count(*) AS quantidade, round(avg(target_resolvida), 4) AS taxa_resolucao "
    "FROM clean_cases WHERE ano_finalizacao IS NOT NULL GROUP BY ano_finalizacao"))
def q_rate_by_year(spark, d):
    return pr.rate_by_year(_clean(spark, d))


def _top_sql(col: str, alias: str) -> str:
    return O.with_ctes(
        f"SELECT coalesce({col}, 'Não informado') AS {alias}, count(*) AS quantidade, "
        f"round(avg(target_resolvida), 4) AS taxa_resolucao FROM clean_cases WHERE ano_finalizacao IS NOT NULL "
        f"GROUP BY 1 ORDER BY quantidade DESC, {alias} LIMIT 20")


@query("top_segments", _top_sql("segmento_de_mercado", "segmento"))
def q_top_segments(spark, d):
    return pr.top_groups(_clean(spark, d), "segmento_de_mercado", "segmento")


@query("top_problem_groups", _top_sql("grupo_problema", "grupo_problema"))
def q_top_problem_groups(spark, d):
    return pr.top_groups(_clean(spark, d), "grupo_problema", "grupo_problema")


_CATALOG_SQL = (
    "SELECT r.source_file AS arquivo, CASE WHEN coalesce(k.kept, 0) = 0 THEN 'sem_dados_filtrados' ELSE 'ok' END AS status, "
    "r.linhas_lidas, CAST(coalesce(k.kept, 0) AS BIGINT) AS linhas_filtradas, k.resolvidas, k.nao_resolvidas, "
    "k.ano_min, k.ano_max FROM (SELECT source_file, count(*) AS linhas_lidas FROM raw_cases GROUP BY 1) r "
    "LEFT JOIN (SELECT source_file, count(*) AS kept, CAST(sum(target_resolvida) AS BIGINT) AS resolvidas, "
    "CAST(count(*) - sum(target_resolvida) AS BIGINT) AS nao_resolvidas, min(ano_finalizacao) AS ano_min, "
    "max(ano_finalizacao) AS ano_max FROM clean_cases GROUP BY 1) k ON r.source_file = k.source_file")


def _catalog(spark, d):
    return pr.processing_catalog((raw_cases(spark, d), _clean(spark, d)))


@query("processing_catalog", O.with_ctes(_CATALOG_SQL))
def q_processing_catalog(spark, d):
    return _catalog(spark, d)


@query("catalog_status", O.with_ctes(f"SELECT status, count(*) AS quantidade FROM ({_CATALOG_SQL}) GROUP BY 1"))
def q_catalog_status(spark, d):
    return pr.catalog_status(_catalog(spark, d))


# --------------------------------------------------------- splits / samples
@query("union_by_name_base", O.with_ctes(
    "SELECT case_id, source_file, regiao, uf, grupo_problema, ano_finalizacao, target_resolvida, "
    "canal_de_origem, NULL::VARCHAR AS segmento_de_mercado FROM clean_cases WHERE ano_finalizacao < 1998 "
    "UNION ALL BY NAME SELECT case_id, source_file, regiao, uf, grupo_problema, ano_finalizacao, target_resolvida, "
    "NULL::VARCHAR AS canal_de_origem, segmento_de_mercado FROM clean_cases WHERE ano_finalizacao >= 1998 "
    "OR ano_finalizacao IS NULL"))
def q_union_by_name_base(spark, d):
    """Parts with drifting columns (early exports lack the segment, later ones
    the channel) unified by name; absent columns read as NULL."""
    c = _clean(spark, d)
    common = ["case_id", "source_file", "regiao", "uf", "grupo_problema", "ano_finalizacao", "target_resolvida"]
    early = c.filter(F.col("ano_finalizacao") < 1998).select(*common, "canal_de_origem")
    late = c.filter((F.col("ano_finalizacao") >= 1998) | F.col("ano_finalizacao").isNull()).select(
        *common, "segmento_de_mercado")
    return union_by_name([early, late])


_SPLITS_CTES = [("train_set", O.modelling_select(TRAIN_WHERE)),
                ("valid_set", O.modelling_select(VALID_WHERE)),
                ("test_set", O.modelling_select(TEST_WHERE))]
_LABELLED_SQL = ("SELECT *, 'Treino' AS conjunto FROM train_set UNION ALL BY NAME "
                 "SELECT *, 'Validação' AS conjunto FROM valid_set UNION ALL BY NAME "
                 "SELECT *, 'Teste' AS conjunto FROM test_set")


@query("labelled_splits", O.with_ctes(_LABELLED_SQL, *_SPLITS_CTES))
def q_labelled_splits(spark, d):
    return labelled_splits(_splits(spark, d))


@query("split_summary", O.with_ctes(
    "SELECT conjunto, count(*) AS linhas, CAST(sum(target_resolvida) AS BIGINT) AS resolvidas, "
    "CAST(count(*) - sum(target_resolvida) AS BIGINT) AS nao_resolvidas, round(avg(target_resolvida), 4) AS taxa_resolucao "
    f"FROM ({_LABELLED_SQL}) GROUP BY conjunto", *_SPLITS_CTES))
def q_split_summary(spark, d):
    return split_summary(labelled_splits(_splits(spark, d)), ["conjunto"])


@query("written_split_summary", O.with_ctes(
    "SELECT conjunto, count(*) AS linhas, CAST(sum(target_resolvida) AS BIGINT) AS resolvidas, "
    "CAST(count(*) - sum(target_resolvida) AS BIGINT) AS nao_resolvidas, round(avg(target_resolvida), 4) AS taxa_resolucao "
    f"FROM ({_LABELLED_SQL}) GROUP BY conjunto", *_SPLITS_CTES))
def q_written_split_summary(spark, d):
    """The three splits written, read back and summarised."""
    return split_summary(write_splits(_splits(spark, d)), ["conjunto"])


@query("modelling_set", O.with_ctes("SELECT * FROM valid_set", *_SPLITS_CTES))
def q_modelling_set(spark, d):
    return _splits(spark, d)["valid"]


@query("train_full", O.with_ctes("SELECT * FROM train_set", *_SPLITS_CTES))
def q_train_full(spark, d):
    return _splits(spark, d)["train"]


@query("sample_fixed", O.with_ctes(
    f"SELECT * FROM train_set ORDER BY md5('{SAMPLE_SEED}:' || CAST(case_id AS VARCHAR)), case_id LIMIT {SAMPLE_N}",
    *_SPLITS_CTES))
def q_sample_fixed(spark, d):
    return sample_fixed(_splits(spark, d)["train"], SAMPLE_N, "case_id", SAMPLE_SEED)


# ---------------------------------------------------------- domain / counts
def _domain_long_sql(fields: list[str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS campo, coalesce(nullif(trim(CAST({f} AS VARCHAR)), ''), 'Não informado') AS valor FROM {src}"
        for f in fields)


@query("domain_values", O.with_ctes(
    "SELECT campo, valor, adicionado FROM (SELECT DISTINCT campo, valor, 0 AS adicionado FROM long_form UNION ALL "
    "SELECT f.campo, 'Não informado', 1 FROM (SELECT DISTINCT campo FROM long_form) f "
    "WHERE NOT EXISTS (SELECT 1 FROM long_form l WHERE l.campo = f.campo AND l.valor = 'Não informado'))",
    *_SPLITS_CTES, ("long_form", _domain_long_sql(FEATURES, "train_set"))))
def q_domain_values(spark, d):
    return pr.domain_values(_splits(spark, d)["train"], FEATURES)


@query("top_values_per_field", O.with_ctes(
    "SELECT campo, valor, quantidade, CAST(rank AS INTEGER) AS rank FROM (SELECT campo, valor, count(*) AS quantidade, "
    "row_number() OVER (PARTITION BY campo ORDER BY count(*) DESC, valor) AS rank FROM long_form GROUP BY 1, 2) "
    "WHERE rank <= 60", ("long_form", _domain_long_sql(FEATURES + ["source_file"], "clean_cases"))))
def q_top_values_per_field(spark, d):
    return pr.top_values_per_field(_clean(spark, d), FEATURES + ["source_file"], 60)


@query("value_counts", O.with_ctes(
    "SELECT valor, quantidade FROM (SELECT coalesce(CAST(uf AS VARCHAR), 'Não informado') AS valor, count(*) AS quantidade "
    "FROM clean_cases GROUP BY 1 ORDER BY quantidade DESC, valor LIMIT 12)"))
def q_value_counts(spark, d):
    return pr.value_counts(_clean(spark, d), "uf", 12)


# ---------------------------------------------------------------- baselines
@query("class_weights", O.with_ctes(
    "SELECT target_resolvida, count(*) AS n_classe, sum(count(*)) OVER () / (2.0 * count(*)) AS peso "
    "FROM train_set GROUP BY 1", *_SPLITS_CTES))
def q_class_weights(spark, d):
    return bl.class_weights(_splits(spark, d)["train"])


_BASE_CTES = O.baseline_scored_ctes(TRAIN_WHERE, VALID_WHERE, TEST_WHERE)


@query("baseline_mean_scores", O.with_ctes(
    "SELECT conjunto, case_id, y, round(p, 9) AS p FROM scored WHERE modelo = 'Baseline - média geral'", *_BASE_CTES))
def q_baseline_mean_scores(spark, d):
    s = baseline_scores(_splits(spark, d))
    return round_doubles(s.filter(F.col("modelo") == bl.BASELINE_GLOBAL).select("conjunto", "case_id", "y", "p"))


@query("baseline_group_scores", O.with_ctes(
    "SELECT conjunto, case_id, y, round(p, 9) AS p FROM scored WHERE modelo = 'Baseline - média por Grupo Problema'",
    *_BASE_CTES))
def q_baseline_group_scores(spark, d):
    s = baseline_scores(_splits(spark, d))
    return round_doubles(s.filter(F.col("modelo") == bl.BASELINE_GROUP).select("conjunto", "case_id", "y", "p"))


# --------------------------------------------------------------- evaluation
_RATE_COLS = ["accuracy", "precision_resolvida", "recall_resolvida", "f1_resolvida",
              "precision_macro", "recall_macro", "f1_macro"]


@query("threshold_sweep", "WITH scored AS (" + EVENTS_SCORED_SQL + "), " + ", ".join(
    f"{n} AS ({s})" for n, s in O.sweep_ctes("scored", [])) +
    " SELECT CAST(i AS INTEGER) AS i, round(threshold, 9) AS threshold, tn, fp, fn, tp, " + _r9(_RATE_COLS) + " FROM sweep")
def q_threshold_sweep(spark, d):
    return round_doubles(ev.threshold_sweep(_events_scored(spark, d)))


@query("best_threshold", O.with_ctes(
    "SELECT modelo, round(threshold, 9) AS threshold, round(best_f1_macro, 9) AS best_f1_macro FROM best",
    *_BASE_CTES, *O.sweep_ctes("scored", ["modelo"], "s.conjunto = 'validacao'"), *O.best_ctes(["modelo"])))
def q_best_threshold(spark, d):
    return round_doubles(choose_thresholds(baseline_scores(_splits(spark, d))))


_METRIC_BODY = (
    "SELECT m.conjunto, m.modelo, round(m.threshold, 9) AS threshold, "
    + ", ".join(f"round(m.{c}, 9) AS {c}" for c in _RATE_COLS)
    + ", round(a.roc_auc, 9) AS roc_auc, round(m.log_loss, 9) AS log_loss, round(m.brier_score, 9) AS brier_score, "
    "m.tn AS tn_nao_resolvida, m.fp AS fp_nao_resolvida_classificada_como_resolvida, "
    "m.fn AS fn_resolvida_classificada_como_nao_resolvida, m.tp AS tp_resolvida "
    "FROM metric_rates m LEFT JOIN auc a ON m.conjunto = a.conjunto AND m.modelo = a.modelo")
_METRIC_CTES = [
    *_BASE_CTES, *O.sweep_ctes("scored", ["modelo"], "s.conjunto = 'validacao'"), *O.best_ctes(["modelo"]),
    ("metric_cells", O.metric_cells_sql("scored", ["conjunto", "modelo"], "JOIN best t ON s.modelo = t.modelo")),
    ("metric_rates", O.rates_select("metric_cells")),
    *O.auc_ctes("scored", ["conjunto", "modelo"], clip=True),
    ("metrics", _METRIC_BODY),
]


def _metrics(spark, d):
    return round_doubles(metric_rows(baseline_scores(_splits(spark, d))))


@query("metrics_valid", O.with_ctes("SELECT * FROM metrics WHERE conjunto = 'validacao'", *_METRIC_CTES))
def q_metrics_valid(spark, d):
    return _metrics(spark, d).filter(F.col("conjunto") == "validacao")


@query("metrics_test", O.with_ctes("SELECT * FROM metrics WHERE conjunto = 'teste'", *_METRIC_CTES))
def q_metrics_test(spark, d):
    return _metrics(spark, d).filter(F.col("conjunto") == "teste")


@query("confusion", O.with_ctes(
    "SELECT conjunto, modelo, celula, quantidade, round(100.0 * quantidade / sum(quantidade) OVER "
    "(PARTITION BY conjunto, modelo), 1)::DOUBLE AS percentual FROM (UNPIVOT metrics ON tn_nao_resolvida AS 'tn', "
    "fp_nao_resolvida_classificada_como_resolvida AS 'fp', fn_resolvida_classificada_como_nao_resolvida AS 'fn', "
    "tp_resolvida AS 'tp' INTO NAME celula VALUE quantidade)", *_METRIC_CTES))
def q_confusion(spark, d):
    from .operators.reports import confusion_cells
    return confusion_cells(_metrics(spark, d))


@query("roc_auc_exact", "WITH scored AS (" + EVENTS_SCORED_SQL + "), " + ", ".join(
    f"{n} AS ({s})" for n, s in O.auc_ctes("scored", [])) + " SELECT round(roc_auc, 9) AS roc_auc FROM auc")
def q_roc_auc_exact(spark, d):
    return round_doubles(ev.roc_auc(_events_scored(spark, d)))


@query("calibration_curve",
       "WITH scored AS (" + EVENTS_SCORED_SQL + "), edges AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, "
       "0.7, 0.8, 0.9]) AS e FROM scored), binned AS (SELECT CAST(len(list_filter(e, lambda x: x < p)) AS INTEGER) AS bin, "
       "p, y FROM scored, edges) SELECT bin, count(*) AS n, round(avg(p), 9) AS prob_pred, "
       "round(avg(CAST(y AS DOUBLE)), 9) AS prob_true FROM binned GROUP BY bin")
def q_calibration_curve(spark, d):
    return round_doubles(ev.calibration_curve(_events_scored(spark, d)))


# ------------------------------------------------------------ tuning grid
from .operators import reports as rp  # noqa: E402
from .operators import scoring as sc  # noqa: E402
from .plans.tuning import RATE_GRID, grid_results, rate_scores  # noqa: E402

_GRID_KEYS = ["modelo", "familia", "configuracao", "params"]
_GRID_JOIN = "JOIN tg_best t ON " + " AND ".join(f"s.{k} = t.{k}" for k in _GRID_KEYS)
_GRID_CTES = [
    *_BASE_CTES, *O.rate_grid_ctes(RATE_GRID),
    *O.sweep_ctes("grid_scored", _GRID_KEYS, pre="tg_"), *O.best_ctes(_GRID_KEYS, pre="tg_"),
    ("tg_cells", O.metric_cells_sql("grid_scored", _GRID_KEYS, _GRID_JOIN)),
    ("tg_rates", O.rates_select("tg_cells")),
    *O.auc_ctes("grid_scored", _GRID_KEYS, pre="tg_", clip=True),
    ("tuning", "SELECT m.modelo, m.familia, m.configuracao, m.params, round(m.threshold, 9) AS threshold, "
               + ", ".join(f"round(m.{c}, 9) AS {c}" for c in ["accuracy", "precision_macro", "recall_macro", "f1_macro",
                                                             "precision_resolvida", "recall_resolvida", "f1_resolvida"])
               + ", round(a.roc_auc, 9) AS roc_auc, round(m.log_loss, 9) AS log_loss, round(m.brier_score, 9) AS brier_score, "
               "m.tn, m.fp, m.fn, m.tp FROM tg_rates m LEFT JOIN tg_auc a ON "
               + " AND ".join(f"m.{k} = a.{k}" for k in _GRID_KEYS)),
]


def _tuning(spark, d):
    s = _splits(spark, d)
    return round_doubles(grid_results(rate_scores(s["train"], s["valid"])))


@query("tuning_grid", O.with_ctes("SELECT * FROM tuning", *_GRID_CTES))
def q_tuning_grid(spark, d):
    return _tuning(spark, d)


def _best_sql(order: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY modelo ORDER BY {order}, configuracao) "
            "AS rn FROM tuning) WHERE rn = 1")


@query("best_config_f1", O.with_ctes(_best_sql("f1_macro DESC"), *_GRID_CTES))
def q_best_config_f1(spark, d):
    return rp.best_config(_tuning(spark, d))


@query("best_config_prob", O.with_ctes(_best_sql("brier_score, log_loss"), *_GRID_CTES))
def q_best_config_prob(spark, d):
    return rp.best_config(_tuning(spark, d), by_probability=True)


_COMPARE_SQL = ("SELECT modelo, f1_macro, roc_auc, brier_score, log_loss FROM metrics WHERE conjunto = 'validacao' "
                "UNION ALL SELECT modelo, f1_macro, roc_auc, brier_score, log_loss FROM (" + _best_sql("f1_macro DESC") + ")")


def _comparison(spark, d):
    """Validation comparison: both baselines + each rate model at its best
    configuration, evaluated in ONE grouped pass (threshold chosen on
    validation for every model/configuration alike)."""
    s = _splits(spark, d)
    base = (baseline_scores(s).filter(F.col("conjunto") == "validacao")
            .select("modelo", F.lit("Baseline").alias("familia"), F.col("modelo").alias("configuracao"),
                    F.lit("{}").alias("params"), "case_id", "y", "p"))
    res = grid_results(union_by_name([base, rate_scores(s["train"], s["valid"])]))
    cols = ["modelo", "f1_macro", "roc_auc", "brier_score", "log_loss"]
    return round_doubles(rp.best_config(res).select(*cols))


@query("leaderboard", O.with_ctes(
    "SELECT CAST(row_number() OVER (ORDER BY f1_macro DESC, modelo) AS INTEGER) AS posicao, modelo AS \"Modelo\", "
    "f1_macro AS valor, f1_macro AS \"F1 macro\", roc_auc AS \"ROC-AUC\", brier_score AS \"Brier\", "
    f"log_loss AS \"Log loss\" FROM ({_COMPARE_SQL})", *_METRIC_CTES, *_GRID_CTES[len(_BASE_CTES):]))
def q_leaderboard(spark, d):
    return rp.leaderboard(_comparison(spark, d))


@query("best_model", O.with_ctes(
    "SELECT * FROM (SELECT 'classificacao' AS criterio, modelo, f1_macro, brier_score, log_loss FROM cmp "
    "WHERE NOT starts_with(modelo, 'Baseline') ORDER BY f1_macro DESC, modelo LIMIT 1) UNION ALL "
    "SELECT * FROM (SELECT 'probabilidade', modelo, f1_macro, brier_score, log_loss FROM cmp "
    "WHERE NOT starts_with(modelo, 'Baseline') ORDER BY brier_score, log_loss, modelo LIMIT 1)",
    *_METRIC_CTES, *_GRID_CTES[len(_BASE_CTES):], ("cmp", _COMPARE_SQL)))
def q_best_model(spark, d):
    return rp.best_model(_comparison(spark, d))


@query("model_names", O.with_ctes("SELECT DISTINCT modelo FROM tuning", *_GRID_CTES))
def q_model_names(spark, d):
    return _tuning(spark, d).select("modelo").distinct()


# ------------------------------------------- rate-derived weights (log-odds)
def _category_stats(train: DataFrame, variables: list[str]) -> DataFrame:
    long = (train.select("target_resolvida", *variables)
                 .unpivot(["target_resolvida"], variables, "variavel", "categoria"))
    return long.groupBy("variavel", "categoria").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("target_resolvida").cast("double").alias("pos"))


def _rate_weights(spark, d):
    """Univariate log-odds ratio of each (variable, category) vs the training
    mean (0.5 added to both counts), and a normalized |rate gap| importance."""
    train = _splits(spark, d)["train"]
    r = bl.global_rate(train)
    st = _category_stats(train, FEATURES)
    coef = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)) - F.log(F.lit(r) / F.lit(1 - r))
    gap = F.col("n") * F.abs(F.col("pos") / F.col("n") - F.lit(r))
    tot = st.agg(F.sum(gap).alias("t")).first()["t"]
    return st.select("variavel", "categoria", coef.alias("coeficiente"), (gap / F.lit(tot)).alias("importancia"))


_WEIGHTS_CTES = [*_SPLITS_CTES,
                 ("global_rate", "SELECT avg(CAST(target_resolvida AS DOUBLE)) AS r FROM train_set"),
                 ("cat_stats", "SELECT variavel, categoria, count(*) AS n, CAST(sum(target_resolvida) AS DOUBLE) AS pos FROM "
                  "(UNPIVOT (SELECT target_resolvida, " + ", ".join(FEATURES) + " FROM train_set) ON "
                  + ", ".join(FEATURES) + " INTO NAME variavel VALUE categoria) GROUP BY 1, 2"),
                 ("gaps", "SELECT *, n * abs(pos / n - (SELECT r FROM global_rate)) AS gap FROM cat_stats"),
                 ("weights", "SELECT variavel, categoria, ln((pos + 0.5) / (n - pos + 0.5)) - "
                  "ln((SELECT r FROM global_rate) / (1 - (SELECT r FROM global_rate))) AS coeficiente, "
                  "gap / (SELECT sum(gap) FROM gaps) AS importancia FROM gaps")]
_ABBREV_CASE = ("CASE variavel " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in FEATURE_ABBREV.items())
                + " ELSE variavel END")
_COEF_SQL = ("SELECT variavel || '_' || categoria AS feature_codificada, coeficiente, variavel, categoria, "
             f"({_ABBREV_CASE}) || ': ' || categoria AS label_grafico, abs(coeficiente) AS abs_coeficiente, "
             "exp(coeficiente) AS odds_ratio FROM weights")


def _coefs(spark, d):
    return rp.coefficient_table(_rate_weights(spark, d))


@query("coef_top", O.with_ctes(
    "SELECT feature_codificada, round(coeficiente, 9) AS coeficiente, variavel, categoria, label_grafico, "
    "round(abs_coeficiente, 9) AS abs_coeficiente, round(odds_ratio, 9) AS odds_ratio FROM coefs "
    "ORDER BY coeficiente DESC, feature_codificada LIMIT 30", *_WEIGHTS_CTES, ("coefs", _COEF_SQL)))
def q_coef_top(spark, d):
    return round_doubles(rp.coefficient_top(_coefs(spark, d), 30))


@query("coef_summary", O.with_ctes(
    "SELECT variavel, round(avg(abs_coeficiente), 9) AS media_abs_coeficiente, round(max(abs_coeficiente), 9) AS "
    "max_abs_coeficiente, count(categoria) AS quantidade_categorias FROM coefs GROUP BY variavel",
    *_WEIGHTS_CTES, ("coefs", _COEF_SQL)))
def q_coef_summary(spark, d):
    return round_doubles(rp.coefficient_summary(_coefs(spark, d)))


_IMP_SQL = ("SELECT variavel || '_' || categoria AS feature_codificada, importancia, variavel, categoria, "
            f"({_ABBREV_CASE}) || ': ' || categoria AS label_grafico FROM weights")


def _imps(spark, d):
    return rp.importance_table(_rate_weights(spark, d))


@query("importance_top", O.with_ctes(
    "SELECT feature_codificada, round(importancia, 9) AS importancia, variavel, categoria, label_grafico FROM imps "
    "ORDER BY importancia DESC, feature_codificada LIMIT 50", *_WEIGHTS_CTES, ("imps", _IMP_SQL)))
def q_importance_top(spark, d):
    return round_doubles(rp.importance_top(_imps(spark, d), 50))


@query("encoded_names", O.with_ctes(
    "SELECT feature_codificada, round(coeficiente, 9) AS coeficiente, variavel, categoria, "
    f"({_ABBREV_CASE}) || ': ' || categoria AS label_grafico, round(abs(coeficiente), 9) AS abs_coeficiente, "
    "round(exp(coeficiente), 9) AS odds_ratio FROM (SELECT 'cat__' || variavel || '_' || categoria AS feature_codificada, coeficiente, "
    "variavel, categoria FROM weights UNION ALL SELECT 'cat__var' || variavel || '_' || categoria, coeficiente, 'variavel_desconhecida', "
    "'var' || variavel || '_' || categoria FROM weights)", *_WEIGHTS_CTES))
def q_encoded_names(spark, d):
    """Coefficients known by their encoded names alone, with and without a known
    variable in front, split into variable and category."""
    w = _rate_weights(spark, d)
    tail = F.concat("variavel", F.lit("_"), "categoria")
    names = w.select(F.explode(F.array(F.concat(F.lit("cat__"), tail), F.concat(F.lit("cat__var"), tail))).alias("feature_codificada"), "coeficiente")
    return round_doubles(rp.encoded_coefficients(names, FEATURES))


@query("importance_summary", O.with_ctes(
    "SELECT variavel, round(sum(importancia), 9) AS importancia_total, round(avg(importancia), 9) AS importancia_media, "
    "count(categoria) AS quantidade_categorias FROM imps GROUP BY variavel", *_WEIGHTS_CTES, ("imps", _IMP_SQL)))
def q_importance_summary(spark, d):
    return round_doubles(rp.importance_summary(_imps(spark, d)))


# ------------------------------------------------------------ case scoring
def _scoring_inputs(spark, d):
    """Test cases with p from the (problem group × segment) rate model, the
    problem-group rates and the training mean."""
    s = _splits(spark, d)
    train, test = s["train"], sc.reindex_features(s["test"], FEATURES)
    general = bl.global_rate(train)
    pair = train.groupBy("grupo_problema", "segmento_de_mercado").agg(
        F.avg(F.col("target_resolvida").cast("double")).alias("taxa_par"))
    scored = (test.join(pair, ["grupo_problema", "segmento_de_mercado"], "left")
                  .withColumn("p", F.coalesce("taxa_par", F.lit(general))).drop("taxa_par"))
    grates = bl.group_rates(train, "grupo_problema")
    return scored, grates, general


_SCORE_CTES = [*_SPLITS_CTES,
               ("global_rate", "SELECT avg(CAST(target_resolvida AS DOUBLE)) AS r FROM train_set"),
               ("pair", "SELECT grupo_problema, segmento_de_mercado, avg(CAST(target_resolvida AS DOUBLE)) AS taxa "
                        "FROM train_set GROUP BY 1, 2"),
               ("grp", "SELECT grupo_problema, avg(CAST(target_resolvida AS DOUBLE)) AS taxa_grupo, count(*) AS n_grupo "
                       "FROM train_set GROUP BY 1"),
               ("sc", "SELECT t.case_id, t.grupo_problema, t.segmento_de_mercado, t.problema, "
                      "coalesce(pr.taxa, (SELECT r FROM global_rate)) AS p, (SELECT r FROM global_rate) AS media_geral, "
                      "coalesce(gr.taxa_grupo, (SELECT r FROM global_rate)) AS media_grupo, gr.n_grupo FROM test_set t "
                      "LEFT JOIN pair pr ON t.grupo_problema = pr.grupo_problema AND t.segmento_de_mercado = pr.segmento_de_mercado "
                      "LEFT JOIN grp gr ON t.grupo_problema = gr.grupo_problema")]


def _band_sql(p, ref):
    return (f"CASE WHEN {p} > {ref} + 0.03 THEN 'acima' WHEN {p} < {ref} - 0.03 THEN 'abaixo' ELSE 'próxima' END")


def _pct_sql(x):
    return f"coalesce(replace(printf('%.1f%%', {x} * 100.0), '.', ','), 'N/A')"


_EXPL_SQL = (f"printf('{sc.EXPLANATION}', {_pct_sql('p')}, {_pct_sql('media_geral')}, {_band_sql('p', 'media_geral')}, "
             f"{_pct_sql('media_grupo')}, {_band_sql('p', 'media_grupo')}, grupo_problema, "
             "coalesce(segmento_de_mercado, 'Não informado'), coalesce(problema, 'Não informado'))")


@query("score_cases", O.with_ctes(
    "SELECT case_id, grupo_problema, round(p, 9) AS p, round(media_geral, 9) AS media_geral, "
    f"round(media_grupo, 9) AS media_grupo, {_band_sql('p', 'media_geral')} AS comparacao_geral, "
    f"{_band_sql('p', 'media_grupo')} AS comparacao_grupo, "
    "CASE WHEN p * 100.0 < 33.0 THEN 'baixa' WHEN p * 100.0 < 66.0 THEN 'media' ELSE 'alta' END AS faixa, "
    f"round((p - media_geral) * 100.0, 9) AS delta_pp, {_EXPL_SQL} AS explicacao FROM sc", *_SCORE_CTES))
def q_score_cases(spark, d):
    scored, grates, general = _scoring_inputs(spark, d)
    return round_doubles(sc.score_cases(scored, grates, general))


@query("explanation_text", O.with_ctes(
    f"SELECT case_id, {_pct_sql('p')} AS probabilidade_txt, {_pct_sql('media_grupo')} AS media_grupo_txt, "
    "replace(format('{:,}', coalesce(n_grupo, 0)), ',', '.') AS casos_grupo_txt FROM sc", *_SCORE_CTES))
def q_explanation_text(spark, d):
    scored, grates, general = _scoring_inputs(spark, d)
    g = F.lit(float(general))
    j = scored.join(grates, "grupo_problema", "left")
    return j.select("case_id", sc.fmt_pct(F.col("p")).alias("probabilidade_txt"),
                    sc.fmt_pct(F.coalesce("taxa_grupo", g)).alias("media_grupo_txt"),
                    sc.fmt_int(F.coalesce(F.col("n_grupo"), F.lit(0))).alias("casos_grupo_txt"))


@query("percent_text", "SELECT o_orderkey, " + _pct_sql("(o_orderkey % 10000) / 10000.0::DOUBLE") + " AS texto FROM orders")
def q_percent_text(spark, d):
    """Rates of four places as percent text: many lie next to a tie."""
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select("o_orderkey", sc.fmt_pct((k % 10000) / F.lit(10000.0)).alias("texto"))


FACTOR_VARIABLES = ["grupo_problema", "segmento_de_mercado", "uf", "regiao"]


@query("factor_match", O.with_ctes(
    "SELECT l.case_id, l.variavel, l.categoria, f.efeito FROM (UNPIVOT (SELECT case_id, "
    + ", ".join(FACTOR_VARIABLES) + " FROM test_set) ON " + ", ".join(FACTOR_VARIABLES)
    + " INTO NAME variavel VALUE categoria) l JOIN factors f ON l.variavel = f.variavel AND l.categoria = f.categoria",
    *_WEIGHTS_CTES, ("coefs", _COEF_SQL),
    ("factors", "SELECT variavel, categoria, 'aumenta' AS efeito FROM (SELECT * FROM coefs ORDER BY coeficiente DESC, "
                "feature_codificada LIMIT 30) UNION ALL SELECT variavel, categoria, 'reduz' FROM (SELECT * FROM coefs "
                "ORDER BY coeficiente, feature_codificada LIMIT 30)")))
def q_factor_match(spark, d):
    coefs = _coefs(spark, d)
    factors = (rp.coefficient_top(coefs, 30, True).select("variavel", "categoria", F.lit("aumenta").alias("efeito"))
               .unionByName(rp.coefficient_top(coefs, 30, False)
                            .select("variavel", "categoria", F.lit("reduz").alias("efeito"))))
    return sc.factor_match(_splits(spark, d)["test"], factors, FACTOR_VARIABLES)


@query("canonicalize_domain", O.with_ctes(
    "SELECT c.case_id, c.candidato, coalesce(dm.valor, lw.by_lower, 'Não informado') AS valor_canonico FROM cands c "
    "LEFT JOIN dom dm ON trim(c.candidato) = dm.valor LEFT JOIN low lw ON lower(trim(c.candidato)) = lw.low",
    *_SPLITS_CTES,
    ("cands", "SELECT case_id, CASE WHEN case_id % 3 = 0 THEN lower(grupo_problema) WHEN case_id % 3 = 1 "
              "THEN grupo_problema ELSE grupo_problema || ' *' END AS candidato FROM test_set"),
    ("dom", "SELECT DISTINCT coalesce(nullif(trim(grupo_problema), ''), 'Não informado') AS valor FROM train_set "
            "UNION SELECT 'Não informado'"),
    ("low", "SELECT lower(valor) AS low, max(valor) AS by_lower FROM dom GROUP BY 1")))
def q_canonicalize_domain(spark, d):
    """Reply values for the problem-group field (as a model might spell them:
    lower-cased, exact, or with trailing noise) mapped onto the known domain."""
    s = _splits(spark, d)
    k = F.col("case_id")
    cands = s["test"].select("case_id", F.when(k % 3 == 0, F.lower("grupo_problema"))
                                          .when(k % 3 == 1, F.col("grupo_problema"))
                                          .otherwise(F.concat("grupo_problema", F.lit(" *"))).alias("candidato"))
    found = sc.canonicalize(cands.withColumn("campo", F.lit("grupo_problema")), "candidato", sc.domain_dictionary(s["train"], ["grupo_problema"]))
    return found.drop("campo")


def _form_replies(spark, d):
    """Replies for whole forms, as a model might give them: JSON of the 14 fields
    with values in upper case, exact, with trailing noise or left out; some
    fenced, some in prose, some without an object."""
    test, k = _splits(spark, d)["test"], F.col("case_id")
    values = [F.when((k + i) % 4 == 0, F.upper(f)).when((k + i) % 4 == 1, F.col(f)).when((k + i) % 4 == 2, F.concat(f, F.lit(" *")))
              .alias(f) for i, f in enumerate(FEATURES)]
    body = F.to_json(F.struct(*values))
    text = (F.when(k % 10 == 9, F.lit("Não sei responder.")).when(k % 10 == 8, F.concat(F.lit("["), body, F.lit("]")))
             .when(k % 10 == 7, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 10 == 6, F.concat(F.lit("Segue: "), body)).otherwise(body))
    return test.select("case_id", text.alias("resposta")), sc.domain_dictionary(_splits(spark, d)["train"], FEATURES)


_FORM_VALUES = " UNION ALL ".join(
    f"SELECT case_id, '{f}' AS campo, CASE (case_id + {i}) % 4 WHEN 0 THEN upper({f}) WHEN 1 THEN {f} WHEN 2 THEN {f} || ' *' "
    "ELSE 'Não informado' END AS informado FROM test_set WHERE case_id % 10 < 8" for i, f in enumerate(FEATURES))


@query("validated_replies", O.with_ctes(
    "SELECT g.case_id, g.campo, g.informado, coalesce(e.valor, b.valor, 'Não informado') AS valor_canonico FROM given g "
    "LEFT JOIN dom e ON e.campo = g.campo AND e.valor = trim(g.informado) LEFT JOIN (SELECT campo, lower(valor) AS baixo, "
    "max(valor) AS valor FROM dom GROUP BY 1, 2) b ON b.campo = g.campo AND b.baixo = lower(trim(g.informado))",
    *_SPLITS_CTES, ("given", _FORM_VALUES),
    ("dom", _domain_long_sql(FEATURES, "train_set").replace("UNION ALL", "UNION")
     + "".join(f" UNION SELECT '{f}', 'Não informado'" for f in FEATURES))))
def q_validated_replies(spark, d):
    """Every field of every readable form reply, mapped onto its domain."""
    replies, dictionary = _form_replies(spark, d)
    return sc.validate_replies(replies, "resposta", dictionary, FEATURES)[0]


@query("reply_errors", O.with_ctes(
    "SELECT case_id, 'sem_objeto' AS erro FROM test_set WHERE case_id % 10 >= 8", *_SPLITS_CTES))
def q_reply_errors(spark, d):
    """Form replies that hold no object."""
    replies, dictionary = _form_replies(spark, d)
    return sc.validate_replies(replies, "resposta", dictionary, FEATURES)[1].select("case_id", "erro")


_REPLY_SQL = ("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' "
              "WHEN 2 THEN 'Resposta: ' || props || ' fim' ELSE '[' || props || ']' END")


@query("json_fields",
       "WITH r AS (SELECT event_id, " + _REPLY_SQL + " AS resposta FROM events), "
       "a AS (SELECT event_id, resposta, CASE WHEN starts_with(trim(resposta), '```') THEN "
       "regexp_replace(trim(resposta), '^[^\\n]*\\n?', '') ELSE trim(resposta) END AS t1 FROM r), "
       "b AS (SELECT event_id, resposta, trim(CASE WHEN ends_with(t1, '```') THEN regexp_replace(t1, '```$', '') ELSE t1 END) "
       "AS t FROM a), c AS (SELECT *, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS span FROM b), "
       "o AS (SELECT event_id, resposta, CASE WHEN json_valid(t) THEN (CASE WHEN json_type(t) = 'OBJECT' THEN t END) "
       "WHEN span <> '' AND json_valid(span) AND json_type(span) = 'OBJECT' THEN span END AS obj FROM c) "
       "SELECT event_id, resposta, obj IS NOT NULL AS valido, json_extract_string(obj, '$.k') AS k FROM o")
def q_json_fields(spark, d):
    """Model-style replies built from event properties (bare JSON, fenced,
    wrapped in prose, or a list) parsed leniently into a field map."""
    e = read_table(spark, d, "events").select("event_id", "props")
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.col("props"))
             .when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("Resposta: "), "props", F.lit(" fim")))
             .otherwise(F.concat(F.lit("["), "props", F.lit("]"))))
    m = sc.parse_reply(text)
    return e.select("event_id", text.alias("resposta"), m.isNotNull().alias("valido"), m["k"].alias("k"))


# ---------------------------------------------------------------- CSV ingest
from .sources import csv_ingest as ci  # noqa: E402
from .sources.csv_export import DISPLAY_HEADERS, export_raw_csv  # noqa: E402


def _and_remove(result: DataFrame, folder: str) -> DataFrame:
    """A result taken from a run's folder, kept apart, and the folder removed."""
    result = result.checkpoint(eager=True)
    remove(result.sparkSession, folder)
    return result


def _channel_counts(cases: DataFrame) -> DataFrame:
    return (cases.groupBy("ano_finalizacao", "canal_de_origem", "segmento_de_mercado")
                 .agg(F.count(F.lit(1)).alias("linhas"), F.sum("target_resolvida").cast("long").alias("resolvidas")))


def _ingested(spark, d):
    return ci.ingest(spark, export_raw_csv(spark, d))


@query("ingest_csv", O.with_ctes(
    "SELECT ano_finalizacao, canal_de_origem, segmento_de_mercado, count(*) AS linhas, "
    "CAST(sum(target_resolvida) AS BIGINT) AS resolvidas FROM clean_cases GROUP BY 1, 2, 3"))
def q_ingest_csv(spark, d):
    """Raw cases exported as CSV in three dialects, then ingested back:
    detection → grouped reads → canonical headers → cleaning → year-partitioned
    part sink → partitioned re-read."""
    import uuid
    from .operators.clean import clean_schema
    from .session import scratch_path
    from pyspark.sql import types as T
    parts = scratch_path(spark, f"parts/{uuid.uuid4().hex}")
    ci.write_parts(_ingested(spark, d).cases, parts)            # part sink, partitioned by close year
    cases = spark.read.schema(clean_schema({"source_file": T.StringType(), "case_id": T.LongType()})).parquet(parts)
    return _and_remove(_channel_counts(cases), parts)


_FILE_DIALECT = (
    "SELECT DISTINCT source_file, CASE WHEN ano_pedido BETWEEN 1998 AND 1999 THEN 'latin1' ELSE 'utf-8-sig' END AS encoding, "
    "CASE WHEN ano_pedido <= 1997 THEN ';' WHEN ano_pedido <= 1999 THEN chr(9) ELSE ',' END AS sep, CAST(0 AS INTEGER) AS skiprows "
    "FROM (SELECT source_file, CAST(substr(source_file, 13, 4) AS INTEGER) AS ano_pedido FROM raw_cases)")


@query("dialect_profile", O.with_ctes(
    f"SELECT source_file AS arquivo, encoding, sep, skiprows, CAST({len(DISPLAY_HEADERS)} AS INTEGER) AS acertos, "
    f"CAST(NULL AS VARCHAR) AS erro FROM ({_FILE_DIALECT})"))
def q_dialect_profile(spark, d):
    return _ingested(spark, d).profile.select("arquivo", "encoding", "sep", "skiprows", "acertos", "erro")


@query("ingest_catalog", O.with_ctes(
    "SELECT c.*, f.encoding, CASE f.sep WHEN chr(9) THEN '''\\t''' ELSE '''' || f.sep || '''' END AS sep, f.skiprows, "
    "CAST(0 AS BIGINT) AS linhas_curtas, CAST(0 AS BIGINT) AS linhas_longas, CAST(NULL AS VARCHAR) AS erro "
    f"FROM ({_CATALOG_SQL}) c JOIN ({_FILE_DIALECT}) f ON c.arquivo = f.source_file"))
def q_ingest_catalog(spark, d):
    return _ingested(spark, d).catalog


@query("file_inventory", O.with_ctes(
    "SELECT source_file, count(*) OVER () AS total_arquivos FROM (SELECT DISTINCT source_file FROM clean_cases) "
    "ORDER BY source_file LIMIT 10"))
def q_file_inventory(spark, d):
    return pr.file_inventory(_clean(spark, d), 10)


@query("schema_describe", O.with_ctes(
    "SELECT column_name, column_type, \"null\" = 'YES' AS nullable FROM (DESCRIBE SELECT * FROM clean_cases)"))
def q_schema_describe(spark, d):
    return pr.describe_schema(spark, _clean(spark, d))


# ------------------------------------------------------------- fitted models
from .operators import models as M  # noqa: E402
from .plans import training as TR  # noqa: E402


def _spec(family: str) -> "M.Spec":
    return next(s for s in TR.FINAL_SPECS if s.family == family)


def _predictions(spark, d, family):
    return round_doubles(TR.predictions(_splits(spark, d), FEATURES, _spec(family)))


@query("logreg_scores")
def q_logreg_scores(spark, d):
    return _predictions(spark, d, "logreg")


@query("tree_scores")
def q_tree_scores(spark, d):
    return _predictions(spark, d, "tree")


@query("gbt_scores")
def q_gbt_scores(spark, d):
    return _predictions(spark, d, "gbt")


@query("svm_platt_scores")
def q_svm_platt_scores(spark, d):
    return _predictions(spark, d, "svm")


@query("train_evaluate")
def q_train_evaluate(spark, d):
    """Validation/test metric rows of both baselines and the four fitted models."""
    return round_doubles(TR.train_evaluate(_splits(spark, d), FEATURES))


@query("tuning_grid_models")
def q_tuning_grid_models(spark, d):
    """All twelve configurations on validation."""
    return round_doubles(TR.tuning_models(_splits(spark, d), FEATURES))


@query("coef_models")
def q_coef_models(spark, d):
    """Coefficient table (with odds ratios) of the fitted logistic regression."""
    model = TR.fitted(_spec("logreg"), _splits(spark, d)["train"], FEATURES)
    return round_doubles(rp.coefficient_table(M.coefficient_weights(model)))


@query("importance_models")
def q_importance_models(spark, d):
    """Feature importances of the fitted boosting model, top 50."""
    model = TR.fitted(_spec("gbt"), _splits(spark, d)["train"], FEATURES)
    return round_doubles(rp.importance_top(rp.importance_table(M.importance_weights(model)), 50))


# ------------------------------------------------------------- streaming
@query("stream_ingest", ORACLE["ingest_csv"])
def q_stream_ingest(spark, d):
    """The CSV exports consumed as file streams (availableNow), cleaned per
    micro-batch into an idempotent, year-partitioned base."""
    import uuid
    from .session import scratch_path
    from .streaming.incremental import run_incremental
    run = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    base = run_incremental(spark, export_raw_csv(spark, d), run + "/out", run + "/ckpt")
    return _and_remove(_channel_counts(base), run)


@query("model_row", O.with_ctes(
    "SELECT * FROM metrics WHERE modelo = 'Baseline - média por Grupo Problema' AND conjunto = 'teste'",
    *_METRIC_CTES))
def q_model_row(spark, d):
    return rp.model_row(_metrics(spark, d), bl.BASELINE_GROUP, "teste")


@query("coef_chart", O.with_ctes(
    "SELECT label_plot, valor_plot FROM (SELECT CASE WHEN length(label_grafico) <= 68 THEN label_grafico "
    "ELSE regexp_extract(label_grafico, '^(.{0,65})(?: |$)', 1) || '...' END AS label_plot, "
    "round(abs(coeficiente), 9) AS valor_plot FROM (SELECT * FROM coefs ORDER BY coeficiente, feature_codificada "
    "LIMIT 30) ORDER BY abs(coeficiente) DESC, label_grafico LIMIT 10)",
    *_WEIGHTS_CTES, ("coefs", _COEF_SQL)))
def q_coef_chart(spark, d):
    """Chart slice of the top-30 decreasing factors: 10 largest |coef|,
    shortened labels, ascending bar order."""
    top_dec = rp.coefficient_top(_coefs(spark, d), 30, increasing=False)
    return round_doubles(rp.chart_slice(top_dec, "coeficiente", "label_grafico", 10, 68))


@query("results_csv", O.with_ctes(
    "SELECT modelo, conjunto, f1_macro AS valor FROM metrics", *_METRIC_CTES))
def q_results_csv(spark, d):
    """Metric rows written as a result CSV and read back with the tolerant
    reader (encoding fallback, column lookup by normalized name, numeric
    coercion)."""
    import uuid
    from .functions.text import find_column
    from .session import scratch_path
    path = scratch_path(spark, f"results/{uuid.uuid4().hex}")
    rp.write_result_csv(_metrics(spark, d), path)
    back = ci.read_result_csv(spark, path)
    f1 = find_column(back.columns, ["F1 Macro", "f1-macro"])
    split = find_column(back.columns, ["Conjunto"])
    return _and_remove(rp.numeric_metric(back.withColumnRenamed(split, "conjunto"), f1, extra=["conjunto"]), path)


# --------------------------------------------------------------- final model
from .operators.folds import stratified_folds  # noqa: E402
from .plans import final as FN  # noqa: E402

_FINAL_CTES = [
    *_GRID_CTES,
    ("choice", "SELECT modelo, configuracao, threshold FROM (SELECT m.modelo, m.configuracao, t.threshold, row_number() OVER "
               "(ORDER BY m.brier_score, m.log_loss, m.modelo, m.configuracao) AS rn FROM tuning m JOIN tg_best t ON "
               + " AND ".join(f"m.{k} = t.{k}" for k in _GRID_KEYS) + ") WHERE rn = 1"),
    *[(n.replace("grid_scored", "final_scored"), s) for n, s in O.rate_grid_ctes(RATE_GRID, "test_set")],
    ("final_rows", "SELECT s.modelo, s.configuracao, s.case_id, s.y, s.p, c.threshold FROM final_scored s "
                   "JOIN choice c ON s.configuracao = c.configuracao AND s.modelo = c.modelo")]


def _final(spark, d):
    return FN.finalize(_splits(spark, d), SPEC, FN.RateFamily(), FEATURES)


@query("final_predictions", O.with_ctes(
    "SELECT modelo, configuracao, case_id, CAST(y AS INTEGER) AS y_true, round(p, 9) AS y_proba, "
    "CAST(p >= threshold AS INTEGER) AS y_pred FROM final_rows", *_FINAL_CTES))
def q_final_predictions(spark, d):
    """Test predictions of the published final model: of all rate models, the
    best by probability on validation."""
    return round_doubles(_final(spark, d).predictions)


@query("final_calibration", O.with_ctes(
    "SELECT bin, count(*) AS n, round(avg(p), 9) AS prob_pred, round(avg(CAST(y AS DOUBLE)), 9) AS prob_true FROM ("
    "SELECT CAST(len(list_filter(e, lambda x: x < p)) AS INTEGER) AS bin, p, y FROM final_rows, (SELECT quantile_cont(p, "
    "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM final_rows)) GROUP BY bin", *_FINAL_CTES))
def q_final_calibration(spark, d):
    """Calibration curve of the published predictions."""
    return round_doubles(ev.calibration_curve(_final(spark, d).predictions, "y_true", "y_proba"))


@query("final_model_predictions")
def q_final_model_predictions(spark, d):
    """Test predictions of the published final model among the four fitted ones."""
    return round_doubles(FN.finalize(_splits(spark, d), SPEC, FN.ModelFamily(), FEATURES).predictions)


@query("stream_scores", O.with_ctes(
    "SELECT case_id, modelo, round(p, 9) AS y_proba, CAST(p >= threshold AS INTEGER) AS y_pred FROM final_rows", *_FINAL_CTES))
def q_stream_scores(spark, d):
    """The cleaned base consumed as a file stream, the test year scored with the
    published final model, batch by batch."""
    import uuid
    from .operators.clean import clean_schema
    from .session import scratch_path
    from .streaming.scoring import run_scoring
    run = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    scores = run_scoring(spark, _final(spark, d), base_path(spark, d), clean_schema(), run + "/scores", run + "/ckpt", (SPEC.test_year, SPEC.test_year))
    return _and_remove(round_doubles(scores), run)


@query("stratified_folds", O.with_ctes(
    "SELECT case_id, target_resolvida, CAST((row_number() OVER (PARTITION BY target_resolvida ORDER BY "
    f"md5('{SAMPLE_SEED}:' || CAST(case_id AS VARCHAR)), case_id) - 1) % 3 AS INTEGER) AS dobra FROM train_set", *_SPLITS_CTES))
def q_stratified_folds(spark, d):
    """Three exactly stratified folds of the training rows."""
    train = _splits(spark, d)["train"].select("case_id", "target_resolvida")
    return stratified_folds(train, "target_resolvida", 3, "case_id", SAMPLE_SEED, into="dobra")


@query("score_cases_model")
def q_score_cases_model(spark, d):
    """Batch case scoring with the saved logistic-regression pipeline, next to
    the general and problem-group historical means."""
    s = _splits(spark, d)
    train, test = s["train"], sc.reindex_features(s["test"], FEATURES)
    model = TR.fitted(_spec("logreg"), train, FEATURES)
    scored = M.score(model, test, ["case_id", *FEATURES])
    return round_doubles(sc.score_cases(scored, bl.group_rates(train, "grupo_problema"), bl.global_rate(train)))


_DIALECT_SQL = (
    "WITH y AS (SELECT *, CAST(substr(source_file, 13, 4) AS INTEGER) AS ano_pedido FROM {src}) "
    "SELECT CASE WHEN ano_pedido BETWEEN 1998 AND 1999 THEN 'latin1' ELSE 'utf-8-sig' END AS encoding, "
    "CASE WHEN ano_pedido <= 1997 THEN '''' || ';' || '''' WHEN ano_pedido <= 1999 THEN '''\\t''' "
    "ELSE '''' || ',' || '''' END AS sep, 0 AS skiprows, {aggs} FROM y GROUP BY 1, 2, 3")


@query("ingest_catalog_by_dialect", O.with_ctes(
    "SELECT r.encoding, r.sep, CAST(r.skiprows AS INTEGER) AS skiprows, r.linhas_lidas, k.linhas_filtradas, "
    "k.resolvidas, k.nao_resolvidas, k.ano_min, k.ano_max FROM (" + _DIALECT_SQL.format(
        src="raw_cases", aggs="count(*) AS linhas_lidas") + ") r JOIN (" + _DIALECT_SQL.format(
        src="clean_cases", aggs="count(*) AS linhas_filtradas, CAST(sum(target_resolvida) AS BIGINT) AS resolvidas, "
                               "CAST(count(*) - sum(target_resolvida) AS BIGINT) AS nao_resolvidas, "
                               "min(ano_finalizacao) AS ano_min, max(ano_finalizacao) AS ano_max")
    + ") k ON r.encoding = k.encoding AND r.sep = k.sep"))
def q_ingest_catalog_by_dialect(spark, d):
    """The ingest catalog summed per detected dialect (file names are Spark's)."""
    cat = _ingested(spark, d).catalog
    return (cat.groupBy("encoding", "sep", "skiprows")
               .agg(F.sum("linhas_lidas").cast("long").alias("linhas_lidas"),
                    F.sum("linhas_filtradas").cast("long").alias("linhas_filtradas"),
                    F.sum("resolvidas").cast("long").alias("resolvidas"),
                    F.sum("nao_resolvidas").cast("long").alias("nao_resolvidas"),
                    F.min("ano_min").alias("ano_min"), F.max("ano_max").alias("ano_max")))
