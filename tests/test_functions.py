import re
import unicodedata

from pyspark.sql import functions as F

from resolva.functions import text
from resolva.functions.dates import parse_mixed_date
from resolva.functions.text import (SENTINEL, blank_to_sentinel, feature_text, header_key,
                                    normalize_value, null_na_tokens, shorten, trim_or_sentinel)
from resolva.operators.scoring import canonicalize, domain_dictionary, fmt_int, fmt_pct, parse_reply, validate_replies


def _col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def _py_norm(v):
    if v is None:
        return ""
    t = unicodedata.normalize("NFKD", str(v).strip())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return "".join(c for c in t if c.isascii() and c.isalnum()).lower()


def test_normalize_value_matches_unicode_rule(spark):
    vals = [" Não Resolvida ", "RESOLVIDA", "Não resolvida", None, "   ", "Finalizada avaliada",
            " FINALIZADA AVALIADA", "Ação—Çedilha ñ ü ß", "½ ĳ", "ÀÉÎÕÜ"]
    got = _col(spark, vals, normalize_value)
    assert got == [_py_norm(v) for v in vals]
    assert got[0] == "naoresolvida" and got[1] == "resolvida" and got[2] == "naoresolvida"


def test_header_key():
    assert header_key("﻿Data Finalização ") == "datafinalizacao"
    assert header_key("Segmento de Mercado") == "segmentodemercado"


def test_mixed_dates(spark):
    vals = ["2024-03-05", "05/03/2024", "31/02/2024", "5/3/2024", "2024-03-05 10:00:00", "NA", "", None, "2024-3-5"]
    got = _col(spark, vals, parse_mixed_date)
    fmt = [g.strftime("%Y-%m-%d %H:%M") if g else None for g in got]
    assert fmt == ["2024-03-05 00:00", "2024-03-05 00:00", None, "2024-03-05 00:00", "2024-03-05 10:00",
                   None, None, None, "2024-03-05 00:00"]


def test_na_tokens_and_sentinels(spark):
    vals = ["NA", "N/A", "null", " NA", "", "x", None]
    assert _col(spark, vals, null_na_tokens) == [None, None, None, " NA", None, "x", None]
    assert _col(spark, ["  a ", "", None], trim_or_sentinel) == ["a", "", SENTINEL]
    assert _col(spark, ["  a ", "   ", None], blank_to_sentinel) == ["a", SENTINEL, SENTINEL]


def test_feature_text_integral_floats(spark):
    assert _col(spark, ["2014.0", "2014", None, "3.5"], feature_text) == ["2014", "2014", SENTINEL, "3.5"]
    assert _col(spark, [2014.0, None], feature_text, "double") == ["2014", SENTINEL]


def test_shorten_word_boundary(spark):
    got = _col(spark, ["Hello   wonderful world", "short", "Supercalifragilistic word"],
               lambda c: shorten(c, 12))
    assert got == ["Hello...", "short", "..."]


def test_parse_reply_lenient(spark):
    vals = ['{"k": 1}', '```json\n{"k": 2}\n```', 'Resposta: {"k": 3} fim', '[{"k": 4}]', "nada", '"txt"']
    got = _col(spark, vals, lambda c: parse_reply(c)["k"])
    assert got == ["1", "2", "3", None, None, None]


def test_formatting(spark):
    assert _col(spark, [0.4931, None], fmt_pct, "double") == ["49,3%", "N/A"]
    assert _col(spark, [1234567], fmt_int, "long") == ["1.234.567"]


def test_canonicalize(spark):
    rows = spark.createDataFrame([("Banco", "S"), ("BANCO", None), ("Loja", "N"), (None, " N ")], "campo_a string, campo_b string")
    dictionary = domain_dictionary(rows, ["campo_a", "campo_b"])
    cands = spark.createDataFrame([(1, "campo_a", "Loja"), (2, "campo_a", "loja"), (3, "campo_a", "banco"), (4, "campo_a", "xyz"),
                                   (5, "campo_a", " Loja "), (6, "campo_b", "loja"), (7, "campo_b", "n"), (8, "campo_b", None),
                                   (9, "campo_a", "BANCO"), (10, None, "S"), (11, "campo_b", "NÃO INFORMADO")], "id int, campo string, c string")
    got = {r["id"]: r["valor_canonico"] for r in canonicalize(cands, "c", dictionary).collect()}
    assert got == {1: "Loja", 2: "Loja", 3: "Banco", 4: SENTINEL, 5: "Loja", 6: SENTINEL, 7: "N", 8: SENTINEL, 9: "BANCO",
                   10: SENTINEL, 11: SENTINEL}


def test_validate_replies(spark):
    dictionary = domain_dictionary(spark.createDataFrame([("Banco", "S")], "a string, b string"), ["a", "b"])
    replies = spark.createDataFrame([(1, '{"a": "banco", "b": null, "c": "x"}'), (2, '```json\n{"b": "s"}\n```'), (3, "[1]"), (4, None),
                                     (5, "{}"), (6, " "), (7, '{"a": 7}')], "case_id int, r string")
    good, bad = validate_replies(replies, "r", dictionary, ["a", "b"])
    got = {(x.case_id, x.campo): x.valor_canonico for x in good.collect()}
    none = SENTINEL
    assert got == {(1, "a"): "Banco", (1, "b"): none, (2, "a"): none, (2, "b"): "S", (5, "a"): none, (5, "b"): none, (7, "a"): none, (7, "b"): none}
    assert {(x.case_id, x.erro) for x in bad.collect()} == {(3, "sem_objeto"), (4, "vazia"), (6, "vazia")}


def test_percent_text_of_every_four_place_rate(spark):
    rates = [i / 10000 for i in range(10001)] + [i / 7919 for i in range(7920)] + [0.0, 1e-300, 5e-324, 0.0005, 1.2799, 2.5, -0.0015, -0.493]
    got = _col(spark, rates, fmt_pct, "double")
    assert got == [f"{x:.1%}".replace(".", ",") for x in rates]


def test_letters_outside_the_basic_plane_fold(spark):
    assert _col(spark, ["𝐅inalizada", "𝟗", "🄰x", "ﬁm"], normalize_value) == ["finalizada", "9", "ax", "fim"]


def test_encoded_names_split_in_declared_order(spark):
    from resolva.operators.reports import encoded_coefficients
    df = spark.createDataFrame([("cat__area_a", 1.0), ("cat__area_x_a", 2.0), ("area_x", 0.0), ("outra_a", -1.0), ("area", 1.0)],
                               "feature_codificada string, coeficiente double")
    first = {r.feature_codificada: (r.variavel, r.categoria) for r in encoded_coefficients(df, ["area", "area_x"]).collect()}
    later = {r.feature_codificada: (r.variavel, r.categoria) for r in encoded_coefficients(df, ["area_x", "area"]).collect()}
    unknown = "variavel_desconhecida"
    assert first == {"cat__area_a": ("area", "a"), "cat__area_x_a": ("area", "x_a"), "area_x": ("area", "x"), "outra_a": (unknown, "outra_a"),
                     "area": (unknown, "area")}
    assert later == first | {"cat__area_x_a": ("area_x", "a")}


def test_folds_compatibility_forms_and_trims_all_white_space(spark):
    rows = [("ﬁnalizada",), ("№ 5",), ("ＦＵＬＬ",), ("\t x ",), (" ",)]
    df = spark.createDataFrame(rows, "t string").select(
        normalize_value(F.col("t")).alias("n"), blank_to_sentinel(F.col("t")).alias("b"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["finalizada", "no5", "full", "x", ""]
    assert got[3][1] == "x" and got[4][1] == SENTINEL


def test_strict_json_and_percent_ties(spark):
    from resolva.operators import scoring as sc
    texts = ['{"a":1} e {"b":2}', "{'k': 1}", '{"k":"v"}', 'x {"k":"v"} y', '{"a":1},{"b":2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(sc.parse_reply(F.col("t")).isNotNull().alias("ok"))
    assert [r.ok for r in df.collect()] == [False, False, True, True, False]
    pct = spark.createDataFrame([(0.0625,), (0.1225,), (0.4931,)], "p double").select(sc.fmt_pct(F.col("p")).alias("s"))
    assert [r.s for r in pct.collect()] == ["6,2%", "12,2%", "49,3%"]


def test_sample_is_exact_on_repeated_keys(spark):
    from resolva.operators.sampling import sample_fixed
    df = spark.range(100).selectExpr("id % 10 AS k", "id AS v", "'c' AS c")
    assert sample_fixed(df, 25, "k").count() == 25
    assert sample_fixed(df.select("k", "c"), 25, "k").count() == 25
    again = [sorted(r.v for r in sample_fixed(df, 25, "k").collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_long_forms_are_sought_by_a_few_ranges(spark):
    """The class that guards the long table covers it, stays short, and values with characters in its gaps are unchanged by it."""
    assert text._MAY_FOLD_MORE.count("-") <= 40
    chars = [*text._FOLD_MORE, *"\u01c7\u2190\u2150ãÇ -_'\x00\x7f\u4e2d\u2014", "a\u0301"]
    df = spark.createDataFrame([(c, f"x {c}Y-9") for c in chars], "c string, v string")
    for r in df.select("*", F.col("c").rlike(text._MAY_FOLD_MORE).alias("may"), text.normalize_value(F.col("v")).alias("n")).collect():
        assert r.may or r.c not in text._FOLD_MORE
        assert r.n == re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", r.v).lower()), r
