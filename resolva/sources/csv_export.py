"""Write the derived raw cases as monthly CSV exports in several dialects.

The exports mimic the original monthly files: display-style accented
headers, three dialects (UTF-8 with ';', latin1 with tabs, UTF-8 with ','
and a different spelling of the segment header), one named file a month.
Written once per input version under the shared checkpoint folder
(`publish.py`).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import _fingerprint
from .publish import file_system, publish, remove
from .tables import raw_cases

# Display headers of the exports.
DISPLAY_HEADERS = {
    "canal_de_origem": "Canal de Origem",
    "regiao": "Região",
    "uf": "UF",
    "segmento_de_mercado": "Segmento de Mercado",
    "grupo_problema": "Grupo Problema",
    "sexo": "Sexo",
    "faixa_etaria": "Faixa Etária",
    "mes_abertura": "Mês Abertura",
    "area": "Área",
    "assunto": "Assunto",
    "problema": "Problema",
    "como_comprou_contratou": "Como Comprou Contratou",
    "procurou_empresa": "Procurou Empresa",
    "ano_abertura": "Ano Abertura",
    "situacao": "Situação",
    "avaliacao_reclamacao": "Avaliação Reclamação",
    "data_finalizacao": "Data Finalização",
}

# (folder, order years, charset, separator, segment header spelling)
DIALECTS = [
    ("utf8_semicolon", (None, 1997), "UTF-8", ";", "Segmento de Mercado"),
    ("latin1_tab", (1998, 1999), "ISO-8859-1", "\t", "Segmento de Mercado"),
    ("utf8_comma", (2000, None), "UTF-8", ",", "Segmento Mercado"),
]


def export_raw_csv(spark: SparkSession, sf_dir: str) -> list[str]:
    """CSV exports of the raw cases; returns the dialect folders."""
    def write(path: str) -> None:
        raw = raw_cases(spark, sf_dir)
        year = F.substring("source_file", 13, 4).cast("int")
        for name, (lo, hi), charset, sep, seg in DIALECTS:
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (year >= lo)
            if hi is not None:
                cond = cond & (year <= hi)
            heads = dict(DISPLAY_HEADERS, segmento_de_mercado=seg)
            out = raw.filter(cond).select("source_file", *[F.col(c).alias(h) for c, h in heads.items()])
            (out.repartition("source_file").write.partitionBy("source_file").option("header", True).option("sep", sep)
                .option("encoding", charset).option("quoteAll", False).csv(f"{path}/{name}-months"))
            _name_months(spark, f"{path}/{name}-months", f"{path}/{name}")

    path = publish(spark, scratch_path(spark, f"csv_export/{_fingerprint(spark, sf_dir)}"), write)["path"]
    return [f"{path}/{name}" for name, *_ in DIALECTS]


def _name_months(spark: SparkSession, months: str, folder: str) -> None:
    """Give each month's only file the name of its folder's value."""
    fs, root = file_system(spark, months)
    _, target = file_system(spark, folder)
    fs.mkdirs(target)
    for month in fs.listStatus(root):
        if not month.isDirectory():
            continue
        name = month.getPath().getName().partition("=")[2]
        files = [f.getPath() for f in fs.listStatus(month.getPath()) if f.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise RuntimeError(f"{name}: {len(files)} files")
        _, named = file_system(spark, f"{folder}/{name}")
        if not fs.rename(files[0], named):
            raise RuntimeError(f"could not name {name}")
    remove(spark, months)
