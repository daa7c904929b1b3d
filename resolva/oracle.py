"""SQL text shared by the independent DuckDB oracle queries.

Each oracle query is `WITH <ctes> SELECT ...` over the shared tables. These
fragments restate the library's semantics in plain SQL (no Spark involved).
"""

from __future__ import annotations

from .sources.tables import RAW_CASES_SQL


def norm(x: str) -> str:
    """SQL for the value normalizer."""
    return f"lower(regexp_replace(strip_accents(trim(coalesce({x}, ''))), '[^a-zA-Z0-9]', '', 'g'))"


def _close_ts(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({t}, '%Y-%m-%d') "
            f"WHEN regexp_matches({t}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN try_strptime({t}, '%d/%m/%Y') "
            f"ELSE NULL END")


_TEXT = ["canal_de_origem", "regiao", "uf", "sexo", "faixa_etaria", "ano_abertura", "mes_abertura",
         "segmento_de_mercado", "area", "assunto", "grupo_problema", "problema", "como_comprou_contratou",
         "procurou_empresa", "situacao", "avaliacao_reclamacao"]
_ABSENT = ["cidade", "data_abertura"]


def _clean_select() -> str:
    cols = ["case_id", "source_file"]
    cols += [f"coalesce(trim({c}), 'Não informado') AS {c}" for c in _TEXT]
    cols += [f"CAST(NULL AS VARCHAR) AS {c}" for c in _ABSENT]
    cols += ["close_ts AS data_finalizacao",
             "CAST(year(close_ts) AS INTEGER) AS ano_finalizacao",
             "CAST(month(close_ts) AS INTEGER) AS mes_finalizacao",
             f"CAST(CASE WHEN {norm('avaliacao_reclamacao')} = 'resolvida' THEN 1 ELSE 0 END AS INTEGER) AS target_resolvida"]
    return (f"SELECT {', '.join(cols)} FROM (SELECT *, {_close_ts('data_finalizacao')} AS close_ts FROM raw_cases) "
            f"WHERE {norm('situacao')} = 'finalizadaavaliada' "
            f"AND {norm('avaliacao_reclamacao')} IN ('resolvida', 'naoresolvida')")


CLEAN_CASES_SQL = _clean_select()

FEATURES_SQL = ["canal_de_origem", "regiao", "uf", "sexo", "faixa_etaria", "ano_abertura",
                "mes_abertura", "segmento_de_mercado", "area", "assunto", "grupo_problema",
                "problema", "como_comprou_contratou", "procurou_empresa"]


def modelling_select(where: str) -> str:
    feats = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Não informado') AS {c}" for c in FEATURES_SQL)
    return (f"SELECT case_id, {feats}, CAST(target_resolvida AS INTEGER) AS target_resolvida FROM clean_cases "
            f"WHERE {where} AND ano_finalizacao IS NOT NULL AND target_resolvida IS NOT NULL")


def with_ctes(body: str, *extra: tuple[str, str]) -> str:
    """Prefix `body` with the raw/clean case CTEs and any extra (name, sql)."""
    ctes = [("raw_cases", RAW_CASES_SQL), ("clean_cases", CLEAN_CASES_SQL), *extra]
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


# ---------------------------------------------------------------- evaluation
GRID_SQL = ("SELECT i, CAST(0.10 AS DOUBLE) + i * ((CAST(0.10 AS DOUBLE) + CAST(0.01 AS DOUBLE)) "
            "- CAST(0.10 AS DOUBLE)) AS t FROM range(81) r(i)")


def _rates_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> str:
    d = lambda c: f"CAST({c} AS DOUBLE)"
    TP, FP, FN, TN = d(tp), d(fp), d(fn), d(tn)

    def sdiv(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"
    p1, r1 = sdiv(TP, f"{TP} + {FP}"), sdiv(TP, f"{TP} + {FN}")
    p0, r0 = sdiv(TN, f"{TN} + {FN}"), sdiv(TN, f"{TN} + {FP}")
    f1 = sdiv(f"2 * {TP}", f"2 * {TP} + {FP} + {FN}")
    f0 = sdiv(f"2 * {TN}", f"2 * {TN} + {FN} + {FP}")
    return (f"{sdiv(f'{TP} + {TN}', f'{TP} + {TN} + {FP} + {FN}')} AS accuracy, "
            f"{p1} AS precision_resolvida, {r1} AS recall_resolvida, {f1} AS f1_resolvida, "
            f"({p0} + {p1}) / 2 AS precision_macro, ({r0} + {r1}) / 2 AS recall_macro, "
            f"({f0} + {f1}) / 2 AS f1_macro")


def sweep_ctes(scored: str, by: list[str], where: str = "TRUE", pre: str = "") -> list[tuple[str, str]]:
    """CTEs `grid`, `sweep_cells`, `sweep` (brute force: every row × every threshold)."""
    b = ", ".join(f"s.{c}" for c in by)
    bsel = (b + ", ") if by else ""
    cells = (f"SELECT {bsel}g.i, g.t AS threshold, "
             "CAST(sum(CASE WHEN s.p >= g.t AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
             "CAST(sum(CASE WHEN s.p >= g.t AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
             "CAST(sum(CASE WHEN s.p < g.t AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
             "CAST(sum(CASE WHEN s.p < g.t AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn "
             f"FROM {scored} s CROSS JOIN {pre}grid g WHERE {where} GROUP BY {bsel}g.i, g.t")
    sweep = f"SELECT *, {_rates_sql()} FROM {pre}sweep_cells"
    return [(f"{pre}grid", GRID_SQL), (f"{pre}sweep_cells", cells), (f"{pre}sweep", sweep)]


def best_ctes(by: list[str], pre: str = "") -> list[tuple[str, str]]:
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    bsel = (", ".join(by) + ", ") if by else ""
    return [(f"{pre}best", f"SELECT {bsel}threshold, f1_macro AS best_f1_macro FROM "
                           f"(SELECT *, row_number() OVER ({part} ORDER BY f1_macro DESC, i) AS rn FROM {pre}sweep) WHERE rn = 1")]


def auc_ctes(scored: str, by: list[str], pre: str = "", clip: bool = False) -> list[tuple[str, str]]:
    if clip:
        scored = f"(SELECT * REPLACE (least(greatest(p, 1e-15), 1 - 1e-15) AS p) FROM {scored})"
    bsel = (", ".join(by) + ", ") if by else ""
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    grp = ("GROUP BY " + ", ".join(by)) if by else ""
    dist = (f"SELECT {bsel}p + 0.0 AS p, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg "
            f"FROM {scored} GROUP BY {bsel}p + 0.0")
    lad = (f"SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
           f"AS neg_below, coalesce(sum(pos) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
           f"AS pos_below FROM {pre}auc_dist")
    auc = (f"SELECT {bsel}CASE WHEN sum(pos) * sum(neg) > 0 THEN "
           "sum(CAST(pos AS DOUBLE) * (neg_below + CAST(neg AS DOUBLE) / 2)) / "
           f"(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc FROM {pre}auc_ladder {grp}")
    return [(f"{pre}auc_dist", dist), (f"{pre}auc_ladder", lad), (f"{pre}auc", auc)]


def metric_cells_sql(scored: str, by: list[str], threshold_join: str) -> str:
    """Confusion cells + log loss + Brier at a threshold column `threshold`."""
    bsel = ", ".join(f"c.{x}" for x in by)
    return (f"SELECT {bsel}, c.threshold, count(*) AS n, "
            "CAST(sum(CASE WHEN c.y = 0 AND c.pc < c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            "CAST(sum(CASE WHEN c.y = 0 AND c.pc >= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            "CAST(sum(CASE WHEN c.y = 1 AND c.pc < c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            "CAST(sum(CASE WHEN c.y = 1 AND c.pc >= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            "-avg(c.y * ln(c.pc) + (1 - c.y) * ln(1 - c.pc)) AS log_loss, "
            "avg((c.pc - c.y) * (c.pc - c.y)) AS brier_score "
            f"FROM (SELECT s.*, t.threshold, least(greatest(s.p, 1e-15), 1 - 1e-15) AS pc FROM {scored} s {threshold_join}) c "
            f"GROUP BY {bsel}, c.threshold")


def rates_select(src: str) -> str:
    return f"SELECT *, {_rates_sql()} FROM {src}"


def baseline_scored_ctes(train_where: str, valid_where: str, test_where: str) -> list[tuple[str, str]]:
    g, gg = "Baseline - média geral", "Baseline - média por Grupo Problema"
    parts = []
    for conj, src in (("validacao", "valid_set"), ("teste", "test_set")):
        parts.append(f"SELECT '{conj}' AS conjunto, '{g}' AS modelo, case_id, target_resolvida AS y, "
                     f"(SELECT r FROM global_rate) AS p FROM {src}")
        parts.append(f"SELECT '{conj}' AS conjunto, '{gg}' AS modelo, v.case_id, v.target_resolvida AS y, "
                     f"coalesce(gr.taxa, (SELECT r FROM global_rate)) AS p FROM {src} v "
                     "LEFT JOIN group_rates gr ON v.grupo_problema = gr.grupo_problema")
    return [
        ("train_set", modelling_select(train_where)),
        ("valid_set", modelling_select(valid_where)),
        ("test_set", modelling_select(test_where)),
        ("global_rate", "SELECT avg(CAST(target_resolvida AS DOUBLE)) AS r FROM train_set"),
        ("group_rates", "SELECT grupo_problema, avg(CAST(target_resolvida AS DOUBLE)) AS taxa FROM train_set GROUP BY 1"),
        ("scored", " UNION ALL ".join(parts)),
    ]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rate_grid_ctes(grid, src: str = "valid_set") -> list[tuple[str, str]]:
    """Scored rows of every rate-model configuration (CTE `grid_scored`)."""
    parts = []
    for model, config, cols in grid:
        on = " AND ".join(f"v.{c} = r.{c}" for c in cols)
        gcols = ", ".join(cols)
        params = "{'colunas': " + repr(cols) + "}"
        parts.append(
            f"SELECT {q(model)} AS modelo, {q('Codificação por alvo')} AS familia, {q(config)} AS configuracao, "
            f"{q(params)} AS params, v.case_id, v.target_resolvida AS y, coalesce(r.taxa, (SELECT r FROM global_rate)) AS p "
            f"FROM {src} v LEFT JOIN (SELECT {gcols}, avg(CAST(target_resolvida AS DOUBLE)) AS taxa FROM train_set "
            f"GROUP BY {gcols}) r ON {on}")
    return [("grid_scored", " UNION ALL ".join(parts))]
