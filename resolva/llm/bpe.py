"""Byte-level BPE encoding and decoding with a given rank table.

Encoding: every text is cut into pre-tokens by the tokenizer's pattern; a
block's distinct pre-tokens are shuffled by word, each distinct word is merged
once per task that owns it, its ids are joined back to the blocks, and every
document is reassembled by position. Decoding joins ids to the token-byte
table, which a vocabulary bounds, inside the task.

The blocks are dealt once, by block; the shuffle of the words and the
reassembly both read that exchange, so both see the same blocks after any
recomputation.

Defined results: a null text is the empty text and has no ids; null and
repeated document ids stay rows of their own; an empty table gives no rows;
an id outside the table is an error. No special tokens are recognised.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from resolva.llm import blocks as B


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring pair of lowest rank, the leftmost of equals,
    until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))       # end[i]: where the piece that starts at i ends; 0 when swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue                  # one of the two pieces has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
           block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: key, n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    split = regex.compile(pattern).findall

    def tokenize(t: str) -> list[bytes]:
        return [w.encode() for w in split(t)]

    def encode_words(batches):
        done: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for data in batch.column(4):
                ids = []
                for w in B.unpack(data.as_py()):
                    if w not in done:
                        done[w] = np.array(merge_word(w, table.value), "<u4").tobytes()
                    ids.append(done[w])
                out.append(B.pack(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], schema=B.ARROW)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        block = B.OpenBlock(left)
        words = block.by_code((p.as_py(), B.unpack(d.as_py())) for p, d in zip(right.column("part"), right.column("data")))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) // 4
        keys, counts, ids = [], [], []
        for k, codes in block.documents():
            keys.append(k)
            counts.append(int(lengths[codes].sum()))
            ids.append(b"".join([words[c] for c in codes.tolist()]))
        return pa.table([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                        names=[key, "n_tokens", "ids"])

    parts = B.n_parts(docs)
    dealt = B.to_blocks(docs, key, text, tokenize, parts, block_bytes=block_bytes).repartition("block")
    encoded = B.word_rows(dealt).repartition("part").mapInArrow(encode_words, B.SCHEMA)
    return dealt.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        assemble, f"`{key}` long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the decoded bytes of a binary id column."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for w, i in ranks.items():
        tokens[i] = w
    table = encoded.sparkSession.sparkContext.broadcast(tokens)
    at = encoded.columns.index(ids)

    def run(batches):
        for batch in batches:
            known = table.value
            out = [b"".join([known[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(into, BinaryType())]))
