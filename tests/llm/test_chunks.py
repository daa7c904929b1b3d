"""Chunk-reuse encoding against the public tokenizer library on whole texts."""

import collections
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from resolva.llm import chunks

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
WHOLE = tokenizers.Tokenizer.from_str(SPEC)


def expected(docs):
    out = collections.Counter()
    for r in docs.collect():
        ids = WHOLE.encode(r.text or "", add_special_tokens=False).ids
        out[r.doc_id, len(ids), tuple(ids), WHOLE.decode(ids, skip_special_tokens=False)] += 1
    return out


def found(docs, **parameters):
    out = chunks.encode(docs, SPEC, decoded="decoded", **parameters)
    again = chunks.decode(out.drop("decoded"), SPEC).collect()
    out = out.collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out))
    return collections.Counter((r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in out)


def noise(rng, n):
    """Text with marks that compose, special tokens, and few or no blanks."""
    bits = ["a", "e", "n", "́", "̈", "İ", "Σ", "ς", "ﬁ", "각", "ᄀ", "ᅡ", "ᆨ", "'s", "'", "l", "don't", " ", "  ", "\n",
            "　", "\x85", "\xa0", "<|endoftext|>", "<|startof", "text|>", "<", "|", "1", "23", "!", "...", "漢", "字", "\U0001F600", "‍",
            "\x0b", "\x1c", "=", "̸", "ạ̀", "word", "the "]
    return "".join(rng.choice(bits) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark, tricky):
    rng = random.Random(11)
    shared = " ".join(rng.choice(["some", "words", "that", "don't", "change", "Über", "42"]) for _ in range(900))
    rows = [noise(rng, rng.choice([50, 400, 3000])) for _ in range(60)]
    rows += [noise(rng, 200) + shared + noise(rng, 200) for _ in range(20)] + [shared] * 30
    rows += ["x" * 30000, "漢字" * 9000, "é" * 9000, " " * 9000, "<|endoftext|>" * 1500, "a" + "́" * 9000, "no blanks," * 3000 + " end"]
    return tricky.unionByName(spark.createDataFrame([(1000 + i, t, "en", "a", 1) for i, t in enumerate(rows)], tricky.schema))


def test_ids_and_decoded_text_equal_the_library(texts, nothing):
    want = expected(texts)
    assert found(texts) == want
    assert found(texts, block_bytes=20000) == want
    assert chunks.encode(nothing, SPEC).count() == 0


def test_clashing_columns_and_shuffled_input(texts):
    clash = texts.repartition(3)
    for c in ("block", "part", "key", "n", "data", "ids", "n_tokens", "decoded"):
        clash = clash.withColumn(c, F.lit("x"))
    assert found(clash) == expected(texts)


def test_cuts_follow_the_content():
    rng = random.Random(5)
    shared = noise(rng, 20000).encode()
    first, second = chunks.cut_chunks(noise(rng, 700).encode() + shared), chunks.cut_chunks(noise(rng, 300).encode() + shared)
    assert len(set(first) & set(second)) > 0.9 * len(first) - 4
    for data in (b"", b"x", b"x" * 50000, "é".encode() * 20000, shared):
        cut = chunks.cut_chunks(data)
        assert b"".join(cut) == data and all(c.decode() and len(c) <= chunks.MOST + chunks.LEAST for c in cut)


def test_borders_that_disagree_stay_open():
    """With a tokenizer that keeps white space, a head alone may differ from the
    whole chunk's start; such borders are not used."""
    class Other(chunks.Encoder):
        def __call__(self, texts):
            return [np.array([len(t), *map(ord, t)], "<u4").tobytes() for t in texts]

    item = chunks.Chunk(Other(SPEC).chunks([b"one two three four"])[0])
    assert item.open and item.head == "one two three four" and item.ids[0] == 18
    held = chunks.Chunk(chunks.Encoder(SPEC).chunks([b"ne two three fou"])[0])
    assert (held.head, held.tail) == ("ne", " fou") and not held.open


def test_words_of_plain_characters_equal_the_library():
    encoder, rng = chunks.Encoder(SPEC), random.Random(3)
    plain = chunks.PLAIN_CHARACTERS
    texts = [plain, *plain, *("".join(rng.choices(plain, k=40)) for _ in range(500)), "it's we'LL '' 's !'s don't<|endoftext|> x"]
    assert chunks.word_rule(SPEC) is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    other = SPEC.replace('"Lowercase"', '"Strip"', 1)
    assert chunks.word_rule(other) is None


def test_common_chunks_have_several_lenders(monkeypatch):
    """Eleven blocks hold one chunk; each gets it from one lender, three at a time."""
    monkeypatch.setattr(chunks, "LENT", 3)
    name = np.array([7, 1], "<u8").tobytes()
    rows = pa.table({"part": [0] * 12, "block": [*range(11), 3], "codes": [np.array([b + 20], "<u4").tobytes() for b in [*range(11), 3]],
                     "names": [name] * 11 + [np.array([8, 1], "<u8").tobytes()]})
    got = chunks._find_shared(rows).to_pylist()
    served = [(h, p) for r in got for h, p in zip(np.frombuffer(r["holders"], "<i8"), np.frombuffer(r["places"], "<u4"))]
    assert sorted(served) == [(b, b + 20) for b in range(11)] and len(got) == 4
    assert all(set(np.frombuffer(r["codes"], "<u4")) == {r["block"] + 20} for r in got)
