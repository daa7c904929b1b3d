import os
import tempfile

import pytest

from resolva.sources import csv_ingest as ci

HEAD = ["Região", "UF", "Canal de Origem", "Segmento de Mercado", "Grupo Problema", "Ano Abertura",
        "Situação", "Avaliação Reclamação", "Data Finalização"]


def _rows(sep, dates):
    body = [
        ["Sudeste", "SP", "Internet", "Bancos", 'Cobrança "indevida"', "2023", "Finalizada avaliada", "Resolvida", dates[0]],
        ["Sul", "PR", " Aplicativo ", "Varejo", "NA", "2023", " FINALIZADA AVALIADA", "Não Resolvida", dates[1]],
        ["Norte", "AM", "Internet", "Bancos", "Atendimento", "", "Finalizada não avaliada", "Não Avaliada", dates[0]],
        ["Sul", "RS", "Internet", "Varejo", "Entrega", "2024", "Finalizada avaliada", "RESOLVIDA", "31/02/2024"],
    ]
    def q(v):
        return '"' + v.replace('"', '""') + '"' if ('"' in v or sep in v) else v
    return "\n".join(sep.join(q(v) for v in r) for r in [HEAD] + body) + "\n"


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="resolva-csv-")
    def w(name, text, enc):
        with open(os.path.join(d, name), "wb") as f:
            f.write(text.encode(enc) if isinstance(text, str) else text)
    w("a_utf8_bom.csv", _rows(";", ["05/03/2024", "2024-03-06"]), "utf-8-sig")
    w("b_latin1_tab.csv", _rows("\t", ["05/03/2024", "06/03/2024"]), "latin1")
    w("c_cp1252_skip.csv", "Relatório – exportação\n" + _rows(";", ["05/03/2025", "06/03/2025"]), "cp1252")
    w("d_comma.csv", _rows(",", ["2026-01-02", "2026-01-03"]), "utf-8-sig")
    w("e_missing_required.csv", "\n".join(";".join(r) for r in
      [HEAD[:-1], ["Sul", "PR", "Internet", "Varejo", "X", "2023", "Finalizada avaliada", "Resolvida"]]) + "\n", "utf-8-sig")
    w("f_nothing_kept.csv", "\n".join(";".join(r) for r in
      [HEAD, ["Sul", "PR", "Internet", "Varejo", "X", "2023", "Cancelada", "Resolvida", "01/01/2024"]]) + "\n", "utf-8-sig")
    w("g_garbage.csv", bytes(range(256)) * 10, None)
    return d


def test_detect_dialect_cases():
    t = ci.detect_dialect(_rows("\t", ["05/03/2024", "06/03/2024"]).encode("latin1"))
    assert (t["encoding"], t["sep"], t["skiprows"], t["acertos"]) == ("latin1", "\t", 0, 9)
    t = ci.detect_dialect(_rows(";", ["05/03/2024", "06/03/2024"]).encode("utf-8-sig"))
    assert (t["encoding"], t["sep"], t["acertos"]) == ("utf-8-sig", ";", 9)
    t = ci.detect_dialect(("Título\n" + _rows(";", ["05/03/2024", "06/03/2024"])).encode("cp1252"))
    assert (t["sep"], t["skiprows"], t["acertos"]) == (";", 1, 9)


def test_ingest_catalog_and_rows(spark, folder):
    res = ci.ingest(spark, [folder])
    cat = {r["arquivo"]: r for r in res.catalog.collect()}
    assert cat["a_utf8_bom.csv"]["status"] == "ok"
    assert (cat["a_utf8_bom.csv"]["linhas_lidas"], cat["a_utf8_bom.csv"]["linhas_filtradas"]) == (4, 3)
    assert (cat["a_utf8_bom.csv"]["resolvidas"], cat["a_utf8_bom.csv"]["nao_resolvidas"]) == (2, 1)
    assert (cat["a_utf8_bom.csv"]["ano_min"], cat["a_utf8_bom.csv"]["ano_max"]) == (2024, 2024)
    assert cat["b_latin1_tab.csv"]["encoding"] == "latin1" and cat["b_latin1_tab.csv"]["sep"] == "'\\t'"
    assert cat["c_cp1252_skip.csv"]["skiprows"] == 1 and cat["c_cp1252_skip.csv"]["linhas_lidas"] == 4
    assert cat["c_cp1252_skip.csv"]["ano_min"] == 2025
    assert cat["d_comma.csv"]["ano_max"] == 2026
    assert cat["e_missing_required.csv"]["status"] == "ignorado_colunas_faltando"
    assert cat["f_nothing_kept.csv"]["status"] == "sem_dados_filtrados"
    assert cat["g_garbage.csv"]["status"] == "erro"
    rows = res.cases.filter("source_file = 'a_utf8_bom.csv'").orderBy("uf").collect()
    pr = [r for r in rows if r["uf"] == "PR"][0]
    assert pr["canal_de_origem"] == "Aplicativo" and pr["grupo_problema"] == "Não informado"
    assert pr["target_resolvida"] == 0
    sp = [r for r in rows if r["uf"] == "SP"][0]
    assert sp["grupo_problema"] == 'Cobrança "indevida"' and sp["regiao"] == "Sudeste"
    rs = [r for r in rows if r["uf"] == "RS"][0]
    assert rs["data_finalizacao"] is None and rs["ano_finalizacao"] is None and rs["target_resolvida"] == 1
    lat = res.cases.filter("source_file = 'b_latin1_tab.csv' AND uf = 'PR'").first()
    assert lat["avaliacao_reclamacao"] == "Não Resolvida"


def test_result_reader_fallback_and_missing(spark, folder):
    p = os.path.join(folder, "res_latin1.txt")
    with open(p, "wb") as f:
        f.write("modelo,f1\nÁrvore,0.5\n".encode("latin1"))
    df = ci.read_result_csv(spark, p)
    assert df.first()["modelo"] == "Árvore"
    from pyspark.sql import types as T
    empty = ci.read_result_csv(spark, os.path.join(folder, "nope.csv"),
                               T.StructType([T.StructField("modelo", T.StringType())]))
    assert empty.count() == 0 and empty.columns == ["modelo"]


def test_result_reader_checks_whole_file(spark, folder):
    p = os.path.join(folder, "res_late_latin1.csv")
    with open(p, "wb") as f:
        f.write(("modelo,f1\n" + "".join(f"m{i},0.5\n" for i in range(20000))).encode("utf-8"))
        f.write("Árvore,0.6\n".encode("latin1"))            # invalid UTF-8 only at the end
    df = ci.read_result_csv(spark, p)
    assert df.filter("f1 = 0.6").first()["modelo"] == "Árvore"


def test_multiline_quoted_fields(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-ml-")
    text = _rows(";", ["05/03/2024", "06/03/2024"]).replace('"Cobrança ""indevida"""', '"Cobrança\nem duas linhas"')
    assert "duas linhas" in text
    with open(os.path.join(d, "ml.csv"), "wb") as f:
        f.write(text.encode("utf-8-sig"))
    res = ci.ingest(spark, [d])
    sp = res.cases.filter("uf = 'SP'").first()
    assert sp["grupo_problema"] == "Cobrança\nem duas linhas"
    assert res.catalog.first()["linhas_lidas"] == 4


def test_user_flow_from_csv_exports(spark, folder):
    """Exports → ingest → part sink → base → temporal splits → baselines → metric rows."""
    from pyspark.sql import types as T

    from resolva.operators.clean import clean_schema
    from resolva.operators.splits import SplitSpec, temporal_splits
    from resolva.plans.evaluation import baseline_scores, metric_rows
    res = ci.ingest(spark, [folder])
    out = tempfile.mkdtemp(prefix="resolva-parts-") + "/base"
    ci.write_parts(res.cases, out)
    base = spark.read.schema(clean_schema({"source_file": T.StringType(), "case_id": T.LongType()})).parquet(out)
    assert base.count() == res.cases.count() and base.select("case_id").distinct().count() == base.count()
    splits = temporal_splits(base, SplitSpec(2014, 2024, 2025, 2025))
    rows = metric_rows(baseline_scores(splits)).collect()
    assert {r["conjunto"] for r in rows} == {"validacao", "teste"} and len(rows) == 4


def _write(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _simple(n, order=None, city="Cobrança"):
    cols = order or HEAD
    row = dict(zip(HEAD, ["Sul", "PR", "Internet", "Varejo", city, "2023", "Finalizada avaliada", "Resolvida", "05/03/2024"]))
    return "\n".join(";".join(r) for r in [cols] + [[row[c] for c in cols]] * n) + "\n"


def test_equal_and_odd_file_names_keep_their_own_counts(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-names-")
    _write(d, "x/dados.csv", _simple(3).encode("utf-8"))
    _write(d, "y/dados.csv", _simple(5).encode("utf-8"))
    _write(d, "dados março 2024 +50%.csv", _simple(2).encode("utf-8"))
    _write(d, "dados [1].csv", _simple(4).encode("utf-8"))
    res = ci.ingest(spark, [d])
    got = sorted((r.arquivo, r.status, r.linhas_lidas, r.linhas_filtradas) for r in res.catalog.collect())
    assert got == [("dados [1].csv", "ok", 4, 4), ("dados março 2024 +50%.csv", "ok", 2, 2),
                   ("dados.csv", "ok", 3, 3), ("dados.csv", "ok", 5, 5)]
    assert {r.source_file for r in res.cases.select("source_file").distinct().collect()} == {x[0] for x in got}


def test_every_file_loses_its_own_title_line(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-titles-")
    for i in range(3):
        _write(d, f"t{i}.csv", (f"Relatório {i}\n" + _simple(3)).encode("utf-8"))
    assert [r.linhas_lidas for r in ci.ingest(spark, [d]).catalog.collect()] == [3, 3, 3]


def test_encoding_is_decided_on_the_whole_file(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-late-")
    ascii_head = [h.encode("ascii", "ignore").decode() for h in HEAD]
    ascii_head[0], ascii_head[6:] = "regiao", ["situacao", "avaliacao_reclamacao", "data_finalizacao"]
    plain = ["Sul", "PR", "Internet", "Varejo", "Entrega", "2023", "Finalizada avaliada", "Resolvida", "05/03/2024"]
    late = plain[:4] + ["Cobrança é já"] + plain[5:]
    text = "\n".join(";".join(r) for r in [ascii_head] + [plain] * 1500 + [late]) + "\n"
    assert len(text) > 80_000
    _write(d, "late.csv", text.encode("utf-8"))
    res = ci.ingest(spark, [d])
    assert res.cases.filter("grupo_problema = 'Cobrança é já'").count() == 1 and res.catalog.first().linhas_lidas == 1501


def test_empty_file_is_an_error_row(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-empty-")
    _write(d, "empty.csv", b"")
    _write(d, "good.csv", _simple(2).encode("utf-8"))
    assert {r.arquivo: r.status for r in ci.ingest(spark, [d]).catalog.collect()} == {"empty.csv": "erro", "good.csv": "ok"}


def test_stream_takes_files_of_different_column_order(spark):
    from resolva.streaming.incremental import run_incremental
    d, out = tempfile.mkdtemp(prefix="resolva-csv-stream-"), tempfile.mkdtemp(prefix="resolva-stream-out-")
    _write(d, "a.csv", _simple(3).encode("utf-8"))
    _write(d, "b.csv", _simple(5, HEAD[::-1]).encode("utf-8"))
    base = run_incremental(spark, [d], out + "/base", out + "/ckpt", out + "/catalog")
    assert base.count() == 8 and base.filter("grupo_problema = 'Cobrança' AND uf = 'PR'").count() == 8
    assert spark.read.parquet(out + "/catalog").count() == 2


def test_rows_with_too_few_or_too_many_fields_leave_a_trace(spark):
    d = tempfile.mkdtemp(prefix="resolva-csv-odd-")
    good = _simple(1).splitlines()[1]
    short, long_ = ";".join(good.split(";")[:-1]), good + ";extra;fields"
    quoted = good.replace("Cobrança", '"a;b"')
    _write(d, "odd.csv", ("\n".join([*_simple(3).splitlines(), short, long_, long_, quoted]) + "\n").encode("utf-8"))
    _write(d, "good.csv", _simple(2).encode("utf-8"))
    _write(d, "titled.csv", ("Título\n" + _simple(2) + short + "\n").encode("utf-8"))
    res = ci.ingest(spark, [d])
    got = {r.arquivo: (r.linhas_lidas, r.linhas_filtradas, r.linhas_curtas, r.linhas_longas) for r in res.catalog.collect()}
    assert got == {"odd.csv": (7, 7, 1, 2), "good.csv": (2, 2, 0, 0), "titled.csv": (3, 3, 1, 0)}
    assert sorted((r.source_file, r.tipo, r.linha) for r in res.malformed.collect()) == sorted(
        [("odd.csv", "curta", short), ("odd.csv", "longa", long_), ("odd.csv", "longa", long_), ("titled.csv", "curta", short)])
    assert res.cases.count() == 12 and res.cases.filter("grupo_problema = 'a;b'").count() == 1
    strict = ci.ingest(spark, [d], reject=True)
    assert strict.cases.count() == 8 and strict.malformed.count() == 4
    assert {r.arquivo: r.linhas_filtradas for r in strict.catalog.collect()} == {"odd.csv": 4, "good.csv": 2, "titled.csv": 2}


def test_stream_sees_empty_files(spark):
    from resolva.streaming.incremental import run_incremental
    d, out = tempfile.mkdtemp(prefix="resolva-csv-stream-"), tempfile.mkdtemp(prefix="resolva-stream-out-")
    _write(d, "empty.csv", b"")
    _write(d, "março +1 [a].csv", _simple(3).encode("utf-8"))
    assert run_incremental(spark, [d], out + "/base", out + "/ckpt", out + "/catalog").count() == 3
    assert {r.arquivo: r.status for r in spark.read.parquet(out + "/catalog").collect()} == {"empty.csv": "erro", "março +1 [a].csv": "ok"}
