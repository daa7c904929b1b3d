"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolva.llm import bpe, chat, chunks, decontaminate, fim, licenses, lines, lm, merkle, neardup, pii, quality, sharding
from resolva.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def bpe_digest(docs: DataFrame) -> DataFrame:
    ranks, pattern = _tokenizer()
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="op3")
    return out.select("doc_id", "text", F.size("findings").cast("long").alias("n_findings"),
                      F.array_join(F.transform("findings", lambda f: F.concat(f["kind"], F.lit("="), f["pseudonym"])), "\n").alias("findings"))


@_query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes_of(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
                      F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.array_join("licenses", ",").alias("licenses"), F.array_join("open_ids", ",").alias("open_ids"))


@_query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(tricky).alias("text"))
    rows = turns.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_conversations(rows)
    back = done.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = quality.materialize(quality.score(docs).drop("text"), "op7")
    return quality.judge(scored).select(
        "doc_id", *[F.col("quality")[c].alias(c) for c in quality.STATS if c != "n_lines"],
        F.col("quality")["base_failed"].alias("base_failed"), "kept")


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_hits(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    tree = sharding.even_tree(2, 2, 2)
    dealt = sharding.shard_rows(rows, "doc_id", tree, sharding.with_region(tree, "r2", 8))
    out = sharding.with_slots(dealt, "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query
def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    out = chunks.encode(read(spark, sf_dir, "documents"), spec, decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@_query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*merkle.RECORD)
    without = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in merkle.RECORD]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(docs, carry={"tampered": F.when(hit, merkle.record_digest(without))})
    path = F.col("path")
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(path).alias("proof_sha256"),
                     merkle.fold(F.coalesce("tampered", "leaf"), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# ------------------------------------------------------------------ SQL twins
def _license_sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    seq = "string_agg('|' || id || '|', '' ORDER BY pos)"
    for name, wanted in licenses.RULES:
        seq = f"replace({seq}, '{''.join(f'|{x}|' for x in wanted)}', '|={name}|')"
    return (
        f"WITH known(sentence, id) AS (VALUES {values}), "
        "cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?:;](\\s|$)', chr(10), 'g'), chr(10)) AS s FROM documents), "
        "said AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS sentence FROM cut), "
        "found AS (SELECT doc_id, pos, id FROM said JOIN known "
        "ON trim(regexp_replace(lower(said.sentence), '[^\\p{L}\\p{N}]+', ' ', 'g')) = known.sentence), "
        "grouped AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, "
        f"list_filter(string_split({seq}, '|'), lambda x: x <> '') AS t FROM found GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, "
        "coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(t, lambda x: x[1] = '='), lambda x: x[2:]))), ','), '') AS licenses, "
        "coalesce(array_to_string(list_filter(t, lambda x: x[1] <> '='), ','), '') AS open_ids "
        "FROM documents d LEFT JOIN grouped USING (doc_id)")


ORACLE["op5_licenses"] = _license_sql()

ORACLE["op6_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
                + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
                + length('<turn role="">') + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

ORACLE["op8_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[p:p + {decontaminate.N - 1}] AS win FROM
       (SELECT item, w, unnest(range(1, greatest(len(w) - {decontaminate.N - 2}, 2))) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, n, p, w[p:p + n - 1] AS win FROM
       (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, p, n FROM dw JOIN bw USING (win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


ORACLE["op12_fim"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
           WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""


def _merkle_sql() -> str:
    def record(text: str) -> str:
        values = {"doc_id": "CAST(doc_id AS VARCHAR)", "n_chars": "CAST(n_chars AS VARCHAR)", "text": text}
        return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')"
                                       for v in (values.get(c, c) for c in merkle.RECORD)) + ")"

    bit = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    crc = ("xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, length(s) + 1), "
           f"lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda c, x: {bit}), 4294967295)")

    def levels(name: str, base: str) -> str:
        return (f"{name}(lvl, g, i, h, n) AS (SELECT 0, g, i, h, count(*) OVER (PARTITION BY g) FROM {base} UNION ALL "
                f"SELECT lvl + 1, g, j, h, count(*) OVER (PARTITION BY g) FROM (SELECT lvl, g, i // 3 AS j, "
                f"sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name} WHERE n > 1 GROUP BY lvl, g, i // 3))")

    def paths(name: str, base: str, tree: str) -> str:
        """The siblings before and after each node of `base` on every level."""
        return (f"{name} AS (SELECT b.g, b.i, t.lvl, "
                "coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < b.i // (3 ** t.lvl)::BIGINT), '') AS l, "
                "coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > b.i // (3 ** t.lvl)::BIGINT), '') AS r "
                f"FROM {base} b JOIN {tree} t ON t.g IS NOT DISTINCT FROM b.g AND t.n > 1 "
                "AND t.i // 3 = b.i // (3 ** (t.lvl + 1))::BIGINT GROUP BY b.g, b.i, t.lvl)")

    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, source AS g, {record('text')} AS h, {record("replace(text, chr(10), '')")} AS cut, "
        "CAST(doc_id AS VARCHAR) AS s FROM documents), "
        f"leaf AS (SELECT doc_id, g, h, CASE WHEN {crc} % 2 = 0 THEN cut ELSE h END AS used, "
        "row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d), "
        f"{levels('low', 'leaf')}, "
        "tops AS (SELECT g AS source, h, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM low WHERE n = 1), "
        f"{levels('high', 'tops')}, {paths('lowpath', 'leaf', 'low')}, {paths('highpath', 'tops', 'high')}, "
        "steps AS (SELECT leaf.g, leaf.i, lvl, l, r FROM leaf JOIN lowpath p ON p.g IS NOT DISTINCT FROM leaf.g AND p.i = leaf.i UNION ALL "
        "SELECT leaf.g, leaf.i, 1000 + lvl, l, r FROM leaf JOIN tops ON tops.source IS NOT DISTINCT FROM leaf.g JOIN highpath p ON p.i = tops.i), "
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY lvl) AS step FROM steps), "
        "fold(g, i, step, h) AS (SELECT g, i, CAST(0 AS BIGINT), used FROM leaf UNION ALL SELECT f.g, f.i, f.step + 1, sha256(s.l || f.h || s.r) "
        "FROM fold f JOIN numbered s ON s.g IS NOT DISTINCT FROM f.g AND s.i = f.i AND s.step = f.step + 1), "
        "ended AS (SELECT g, i, arg_max(h, step) AS h FROM fold GROUP BY g, i), "
        "proofs AS (SELECT g, i, string_agg(l || r, '' ORDER BY step) AS p FROM numbered GROUP BY g, i) "
        "SELECT leaf.doc_id, leaf.h AS leaf, tops.h AS subroot, high.h AS root, sha256(coalesce(p, '')) AS proof_sha256, "
        "ended.h AS folded_root, ended.h = high.h AS verified FROM leaf JOIN tops ON tops.source IS NOT DISTINCT FROM leaf.g "
        "JOIN high ON high.n = 1 JOIN ended ON ended.g IS NOT DISTINCT FROM leaf.g AND ended.i = leaf.i "
        "LEFT JOIN proofs ON proofs.g IS NOT DISTINCT FROM leaf.g AND proofs.i = leaf.i")


ORACLE["op13_merkle"] = _merkle_sql()
