"""Canonical column names of the complaint data model (fixed values)."""

from __future__ import annotations

# Normalized raw header spelling → canonical column name.
# Two spellings map to the market segment.
HEADER_MAP = {
    "gestor": "gestor",
    "canaldeorigem": "canal_de_origem",
    "regiao": "regiao",
    "uf": "uf",
    "cidade": "cidade",
    "sexo": "sexo",
    "faixaetaria": "faixa_etaria",
    "anoabertura": "ano_abertura",
    "mesabertura": "mes_abertura",
    "dataabertura": "data_abertura",
    "dataresposta": "data_resposta",
    "dataanalise": "data_analise",
    "datarecusa": "data_recusa",
    "datafinalizacao": "data_finalizacao",
    "prazoresposta": "prazo_resposta",
    "prazoanalisegestor": "prazo_analise_gestor",
    "temporesposta": "tempo_resposta",
    "nomefantasia": "nome_fantasia",
    "segmentodemercado": "segmento_de_mercado",
    "segmentomercado": "segmento_de_mercado",
    "area": "area",
    "assunto": "assunto",
    "grupoproblema": "grupo_problema",
    "problema": "problema",
    "comocomproucontratou": "como_comprou_contratou",
    "procurouempresa": "procurou_empresa",
    "respondida": "respondida",
    "situacao": "situacao",
    "avaliacaoreclamacao": "avaliacao_reclamacao",
    "notadoconsumidor": "nota_do_consumidor",
    "analisedarecusa": "analise_da_recusa",
}

# Columns kept in a cleaned part, in output order.
CASE_COLUMNS = [
    "canal_de_origem", "regiao", "uf", "cidade", "sexo", "faixa_etaria",
    "ano_abertura", "mes_abertura", "data_abertura", "data_finalizacao",
    "segmento_de_mercado", "area", "assunto", "grupo_problema", "problema",
    "como_comprou_contratou", "procurou_empresa", "situacao", "avaliacao_reclamacao",
]

REQUIRED_COLUMNS = ["situacao", "avaliacao_reclamacao", "data_finalizacao"]

# The 14 model features, in model order.
FEATURES = [
    "canal_de_origem", "regiao", "uf", "sexo", "faixa_etaria", "ano_abertura",
    "mes_abertura", "segmento_de_mercado", "area", "assunto", "grupo_problema",
    "problema", "como_comprou_contratou", "procurou_empresa",
]

TARGET = "target_resolvida"
CLOSE_YEAR = "ano_finalizacao"
CLOSE_MONTH = "mes_finalizacao"

# Normalized status / evaluation spellings kept by the filter.
STATUS_FINALIZED_EVALUATED = "finalizadaavaliada"
EVAL_RESOLVED = "resolvida"
EVAL_NOT_RESOLVED = "naoresolvida"

# Display abbreviations of the features (fixed values).
FEATURE_ABBREV = {
    "canal_de_origem": "Canal",
    "regiao": "Região",
    "uf": "UF",
    "sexo": "Sexo",
    "faixa_etaria": "Faixa etária",
    "ano_abertura": "Ano",
    "mes_abertura": "Mês",
    "segmento_de_mercado": "Segmento",
    "area": "Área",
    "assunto": "Assunto",
    "grupo_problema": "Grupo",
    "problema": "Problema",
    "como_comprou_contratou": "Compra",
    "procurou_empresa": "Procurou empresa",
}
