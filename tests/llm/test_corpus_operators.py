"""Joins, components, sharding, scores and the pipeline against brute force."""

import collections
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from resolva.llm import components, decontaminate, lines, lm, neardup, sharding
from resolva.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.conftest import sentence


def union_find(n, pairs):
    parent = {i: i for i in n}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in n}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (41, 40), (40, 42), (42, 41)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {k: v for k, v in union_find({x for p in pairs for x in p}, pairs).items() if k != 30}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_jaccard_join_matches_all_pairs(spark, monkeypatch):
    texts = [sentence(i, 60) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for j in range(40):  # a large group of near copies, cut into chunks
        w = texts[0].split()
        w[(j * 3) % 60] = f"edit{j}"
        rows.append((100 + j, " ".join(w)))
    rows += [(200, texts[1]), (201, texts[1]), (202, None), (203, ""), (204, "one two"), (205, "one two")]
    monkeypatch.setattr(neardup, "CHUNK", 16)
    monkeypatch.setattr(neardup, "BIN_ROWS", 4)
    got = {r.doc_id: r for r in neardup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = shingle_sets(rows)
    pairs = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    classes, links = union_find(s, pairs), collections.Counter(x for p in pairs for x in p)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (classes[i], links[i]) for i in s}


def test_keep_one_on_tricky_rows(clashing, nothing):
    out = neardup.keep_one(clashing)
    assert out.columns == clashing.columns
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert ids[3] == 1 and ids[4] == 0 and ids[5] == 0 and ids[10] == 1 and ids[None] == 1 and ids[6] == ids[7] == ids[8] == 1
    assert neardup.classes_of(nothing).count() == 0


def test_depth_shortens_until_the_target():
    assert [neardup.depth_for(0.8, 16, t) for t in (0.5, 0.97, 0.99, 0.999)] == [8, 7, 6, 4]


def test_line_dedup_matches_brute_force(spark):
    base = sentence(4, 20)
    rows = [(1, base + "\nkeep me"), (2, "other\n" + base), (3, base[:-1] + "x\n\n" + sentence(8, 20)), (4, base), (5, "abc\nabd\nabc"), (6, None), (7, " \n ")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in
           lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (base + "\nkeep me", 2, 0), 2: ("other", 2, 1), 3: ("\n" + sentence(8, 20), 2, 1), 4: ("", 1, 1),
                   5: ("abc\nabd", 3, 1), 6: (None, 0, 0), 7: (" \n ", 0, 0)}


def test_line_rounds_settle_mixed_bands(spark, monkeypatch):
    """One first band shared by lines of two groups: the second group is found in a later round."""
    a, b = "first group of equal looking lines that go on", "second set with other characters and more of them"
    texts = [a + str(i) for i in range(4)] + [b + str(i) for i in range(4)]
    whole = lines.band
    monkeypatch.setattr(lines, "band", lambda m, s, run: F.lit(1).cast("long") if run == lines.RUNS[0] else whole(m, s, run))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    assert got == {i: int(i not in (0, 4)) for i in range(8)}


def test_every_band_settles(spark, monkeypatch):
    """One band for all lines: more groups than pivots of a few rounds, and chains whose ends are not near each other."""
    monkeypatch.setattr(lines, "band", lambda m, s, run: F.lit(1).cast("long"))
    chars = lambda g, n: "".join(chr(0x4E00 + 300 * g + i) for i in range(n))
    texts = [x for g in range(7) for x in (chars(g, 60), chars(g, 61))]
    texts += [x for g in range(7, 10) for x in (chars(g, 50), chars(g, 60), chars(g, 70))]  # 45, 55 and 65 shingles
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup(docs).orderBy("doc_id").collect()] == [0, 1] * 7 + [0, 1, 1] * 3


def test_one_missing_shingle_of_five(spark):
    texts = [x for g in range(12) for x in ("".join(chr(0x4E00 + 20 * g + i) for i in range(n)) for n in (10, 9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup(docs).orderBy("doc_id").collect()] == [0, 1] * 12


def test_one_changed_character_in_a_short_line(spark):
    """65 different characters; a change in the middle leaves Jaccard 54 / 66 on 6-character shingles."""
    line = "".join(chr(0x4E00 + i) for i in range(65))
    docs = spark.createDataFrame([(1, line), (2, line[:32] + "x" + line[33:])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()} == {1: 0, 2: 1}


def test_line_rounds_do_not_read_the_documents_again(spark, monkeypatch):
    """However many rounds there are, the documents are cut into lines for the sketches, the shared lines' texts and the result."""
    monkeypatch.setattr(lines, "band", lambda m, s, run: F.lit(1).cast("long"))
    calls, whole = [], lines._explode
    monkeypatch.setattr(lines, "_explode", lambda *a: calls.append(1) or whole(*a))
    text = lambda i: " ".join(f"{chr(97 + (i * 7 + j) % 26) * 3}{i}{j}" for j in range(12))
    docs = spark.createDataFrame([(2 * i + j, text(i) + " end" * j) for i in range(6) for j in range(2)], "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup(docs).orderBy("doc_id").collect()] == [0, 1] * 6
    assert len(calls) == 3


def test_tables_of_the_line_rounds_go_with_the_run(spark):
    """Only the removed lines, which the result reads, stay in the checkpoint folder."""
    folder = scratch_path(spark, "llm").removeprefix("file:")
    docs = spark.createDataFrame([(i, sentence(3, 20) + " end" * (i % 2)) for i in range(4)], "doc_id long, text string")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = lines.dedup(docs)
    left = sorted(set(os.listdir(folder)) - before)
    assert [x.rpartition("-")[0] for x in left] == ["lines-removed"]
    assert [r.n_removed for r in out.orderBy("doc_id").collect()] == [0, 1, 1, 1]


def test_similar_small_sets_share_a_band(spark):
    """Sets that are whole in their sketches and share 0.8 of their union have a common band, however the others fall between."""
    draw, rows = random.Random(5), []
    for _ in range(4000):
        common = draw.randint(4, 22)
        odd = draw.randint(0, min(common // 4, lines.MINIMA - common))
        union = draw.sample(range(10 ** 6), common + odd)
        own = draw.randint(0, odd)
        rows.append((sorted(union[:common] + union[common:common + own]), sorted(union[:common] + union[common + own:])))
    pairs = spark.createDataFrame(rows, "a array<int>, b array<int>")
    apart = pairs.filter(~F.arrays_overlap(lines.bands(F.col("a")), lines.bands(F.col("b"))))
    assert pairs.count() == 4000 and apart.count() == 0


def test_line_dedup_on_tricky_rows(clashing, nothing):
    out = lines.remove_lines(clashing)
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert out.columns == clashing.columns and ids[5] == 0 and ids[3] == 1 and ids[6] == ids[7] == 1 and ids[10] == 2 and ids[None] == 2
    assert lines.dedup(nothing).count() == 0


def test_shards(spark, clashing, nothing):
    tree = sharding.even_tree(2, 2, 2)
    grown = sharding.with_region(tree, "r2", 8)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.with_slots(sharding.shard_rows(df, "doc_id", tree, grown), "doc_id", ["text"]).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert set(out.grown_shard[out.grown_shard != out["shard"]]) == {8}
    assert out["shard"].value_counts().between(400, 600).all() and 350 < (out.grown_shard == 8).sum() < 550
    heavier = sharding.tree_of({"r0": {"k0": {0: 1, 1: 1}, "k1": {2: 1, 3: 3}}, "r1": {"k0": {4: 1, 5: 1}, "k1": {6: 1, 7: 1}}})
    moved = sharding.shard_rows(df, "doc_id", tree, heavier).filter("shard <> grown_shard").toPandas()
    assert set(moved.grown_shard) <= {0, 1, 2, 3} and len(moved)  # rows move only into the region that grew
    odd = sharding.with_slots(sharding.shard_rows(clashing, "doc_id", tree), "doc_id", ["text"])
    assert odd.count() == clashing.count() and sharding.with_slots(sharding.shard_rows(nothing, "doc_id", tree), "doc_id", ["text"]).count() == 0


def test_lm_counts_and_normalisation(spark, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]
    held = lambda k: zlib.crc32(("null" if k is None else str(k)).encode()) % 5 == 1
    c = collections.Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                                round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for k, t in rows)
    out = lm.score(clashing, block_bytes=3000).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out) and lm.score(nothing).count() == 0


def test_lm_class_probabilities_sum_to_one():
    import numpy as np
    m = lm.start(np.arange(lm.TOP + lm.BUCKETS))
    z = lm.log_normaliser(m)
    for a, b in ((0, 0), (5, 1500)):
        s = (m["r"][a] * m["c"][0] + m["r"][b] * m["c"][1]) @ m["q"].T + m["b"] - z[a, b]
        assert np.exp(s.astype("f8")).sum() == pytest.approx(1, abs=1e-4)


def test_lm_beats_unigrams_on_held_out_text(spark):
    rows = [(i, " ".join(f"{'abcdefgh'[(i + j) % 8]}{(i + j) % 8}" for j in range(400))) for i in range(200)]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(
        F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert out.m > out.b


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert len(corpus_pipeline.STAGES) == 5 and 0.4 * n < out.count() < n
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_output_names_of_the_caller_change_nothing(spark, tricky):
    """Documents that already have columns with the operators' output names."""

    from resolva.llm import licenses
    bench = spark.createDataFrame([("a", sentence(1, 30))], "item_id string, text string")
    clash = tricky
    for c in ("kept", "quality", "n_removed", "n_lines", "n_hit", "items", "n_words", "hit_spans", "licenses", "sentence_ids", "open_ids", "shard", "grown_shard"):
        clash = clash.withColumn(c, F.lit("caller"))
    plain = lambda df: sorted(map(str, df.select(*tricky.columns).collect()))
    for stage in (corpus_pipeline.quality_rules, lambda s, d, _: lines.remove_lines(d), lambda s, d, _: decontaminate.remove_documents(d, bench)):
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and out.filter("kept <> 'caller' OR items <> 'caller' OR n_removed <> 'caller'").count() == 0
        assert plain(out) == plain(stage(spark, tricky, ""))
    found = licenses.scan_licenses(clash)
    assert found.columns[-3:] == ["_sentence_ids", "_licenses", "_open_ids"] and found.filter("licenses <> 'caller'").count() == 0
    dealt = sharding.shard_rows(clash, "doc_id", sharding.even_tree(2, 2, 2))
    want = sharding.shard_rows(tricky, "doc_id", sharding.even_tree(2, 2, 2))
    assert dealt.columns[-1] == "_shard" and dealt.filter("shard <> 'caller'").count() == 0
    assert sorted(str(r) for r in dealt.select("doc_id", F.col("_shard").alias("shard")).collect()) == sorted(str(r) for r in want.select("doc_id", "shard").collect())


def test_slots_of_one_hot_key_are_spread(spark):
    """20,000 rows without a key are one shard's, but no slot group's."""
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    dealt = sharding.shard_rows(df, "doc_id", sharding.even_tree(2, 2, 2))
    out = sharding.with_slots(dealt, "doc_id", ["text"])
    assert sorted(r.slot for r in out.collect()) == list(range(20_000)) and out.columns == [*dealt.columns, "slot"]
    plan = sharding.with_slots(dealt, "doc_id", ["text"])
    assert plan.select("shard").distinct().count() == 1


def test_line_dedup_equals_all_pairs(spark, nothing):
    """Every pair of lines compared in plain Python; components keep their first line."""
    import random
    rng, rows, seen = random.Random(4), [], []
    for i in range(40):
        lines_ = []
        for j in range(rng.randint(1, 6)):
            old = rng.choice(seen) if seen and rng.random() < 0.5 else None
            if old and rng.random() < 0.3:
                line = old
            elif old:
                at = rng.randrange(len(old))
                line = old[:at] + rng.choice("XYZ") + old[at + rng.randint(0, 1):]
            else:
                line = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(14, 24)))
            lines_.append(line)
            seen.append(line)
        rows.append((None if i == 7 else i, "\n".join([*lines_, "", "ab"][: len(lines_) + i % 3]), "en", "a", 1))
    docs = spark.createDataFrame(rows, nothing.schema)
    shingles = lambda s: {s[i:i + 6] for i in range(len(s) - 5)} or {s}
    place = {}
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        for pos, line in enumerate(r.text.split("\n")):
            if line.strip():
                at = (r.doc_id is not None, r.doc_id or 0, r.h, pos)
                place[line] = min(place.get(line, at), at)
    names = sorted(place)
    sets = [shingles(x) for x in names]
    near = [(a, b) for b in range(len(names)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 30
    root = union_find(range(len(names)), near)
    first = {}
    for i, x in enumerate(names):
        first[root[i]] = min(first.get(root[i], place[x]), place[x])
    keep = {place[x] for i, x in enumerate(names) if place[x] == first[root[i]]}
    want = collections.Counter()
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        stay = [x for pos, x in enumerate(r.text.split("\n")) if not x.strip() or (r.doc_id is not None, r.doc_id or 0, r.h, pos) in keep]
        want[r.doc_id, "\n".join(stay)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in lines.dedup(docs).collect()) == want


def test_pipeline_stages_take_tricky_and_empty_tables(spark, clashing, nothing):
    for docs, name in ((clashing, "tricky"), (nothing, "nothing")):
        n = docs.count()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_SMALL)
            if i < 4:
                assert out.columns == docs.columns, name
                docs = corpus_pipeline.materialize(out, "test-stage")
        assert out.count() == docs.count() <= n
        if name == "tricky":
            assert {r.doc_id for r in docs.collect()} >= {2, 9, 10}       # clean documents stay
