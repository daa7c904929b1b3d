"""Fill-in-the-middle and Merkle manifest against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolva.llm import fim, merkle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fim_by_hand(key, text):
    text = text or ""
    units, h = UNIT.findall(text), H(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts(spark, tricky):
    odd = ["<P> in the text", "a <S", "<", " ", "\n\n", "x", " x ", "é" * 9000, "　wide space \U0001F600 ", "a\x85b\x1cc d",
           "word " * 5000, " " * 9000 + "end", "<M", "S><P <S <M trailing <", "\x0b\x0cmixed\r\n\t tabs"]
    more = spark.createDataFrame([(1000 + i, t, "en", "a", 1) for i, t in enumerate(odd * 4)], tricky.schema)
    return tricky.unionByName(more)


def test_fim_matches_plain_python_and_restores(texts, nothing):
    out = fim.transform(texts).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    assert got == collections.Counter(fim_by_hand(r.doc_id, r.text) for r in texts.collect())
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    want = collections.Counter((r.doc_id, r.text or "") for r in texts.collect())
    assert collections.Counter((r.doc_id, r.restored) for r in out) == want
    assert fim.transform(nothing).count() == 0


def test_fim_ignores_clashing_columns(texts):
    clash = texts
    for c in ("k", "t", "hex", "h1", "cut", "n", "form", "output", "prefix", "middle", "suffix"):
        clash = clash.withColumn(c, F.lit("x"))
    assert sorted(map(str, fim.transform(clash).collect())) == sorted(map(str, fim.transform(texts).collect()))


def test_fim_parameters(texts):
    out = fim.transform(texts, percent=100, spm_percent=0, sentinels=("[pre]", "[suf]", "[mid]"))
    out = out.withColumn("restored", fim.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert {r.form for r in out if r.output} == {"psm"}
    assert collections.Counter(r.restored for r in out) == collections.Counter(r.text or "" for r in texts.collect())


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_block_counts_find_every_mark(block):
    rng = random.Random(block)
    for size in (0, 1, 2, 15, 16, 17, 100, 1000):
        marks = np.array([rng.random() < 0.3 for _ in range(size)], bool)
        counts, places = fim.BlockCounts(marks, block), np.flatnonzero(marks)
        assert counts.total == len(places)
        assert [counts.find(k + 1) for k in range(len(places))] == (places + 1).tolist()
        blocks = -(-size // block)
        assert [counts.before(b) for b in range(blocks + 1)] == [int(marks[:b * block].sum()) for b in range(blocks + 1)]


def tree_by_hand(leaves):
    """Top digest, and per leaf the siblings before and after it on every level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
        at = [i // 3 for i in at]
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def manifest_by_hand(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        leaf = H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_by_hand([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = tree_by_hand([trees[g][0] for g in order])
    return collections.Counter(
        (key if known else None, leaf, trees[g][0], root, tuple(path + up))
        for g, up in zip(order, above) for (known, key, leaf), path in zip(sorted(groups[g]), trees[g][1]))


def as_rows(out):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in out.collect())


def test_manifest_of_tricky_rows(tricky, nothing):
    clash = tricky
    for c in ("g", "k", "leaf", "kept", "u", "range", "at", "n", "pos", "node", "b", "top", "root", "path"):
        clash = clash.withColumn(c, F.lit("x"))
    want = manifest_by_hand(tricky.collect())
    assert as_rows(merkle.manifest(tricky)) == want
    assert as_rows(merkle.manifest(clash)) == want
    assert merkle.manifest(nothing).count() == 0


@pytest.mark.parametrize("sizes", [[1], [244], [1, 3, 4, 243, 244, 729, 2, 730], [1] * 260])
def test_manifest_over_block_borders(spark, nothing, sizes):
    """Sources below, at and above a block, and more sources than a block holds."""
    rows = [(i * 1000 + j, f"text {j}", "en", f"s{i:03d}", j) for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, nothing.schema)
    assert as_rows(merkle.manifest(docs)) == manifest_by_hand(docs.collect())


def test_manifest_with_a_hot_source_and_equal_rows(spark, nothing):
    """Most rows in one source, many of them equal, three rounds of blocks."""
    hot = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"),
                                    F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    docs = hot.unionByName(spark.createDataFrame([(1, "x", None, None, None), (2, None, "en", "a", 0)], nothing.schema))
    out = merkle.manifest(docs).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    assert as_rows(out) == manifest_by_hand(docs.collect())
    assert out.filter("folded <> root").count() == 0


def test_fold_finds_changed_leaves(tricky):
    changed = merkle.record_digest([F.replace(c, F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.RECORD])
    out = merkle.manifest(tricky, carry={"other": changed, "has_break": F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))})
    for r in out.select("*", merkle.fold(F.col("other"), F.col("path")).alias("folded"), merkle.proof_digest(F.col("path")).alias("proof")).collect():
        assert (r.folded == r.root) == (not r.has_break)
        assert r.proof == H(*[s.before + s.after for s in r.path])
