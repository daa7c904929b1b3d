"""Documents as blocks of word codes.

A scan task cuts its documents into blocks of about BLOCK_BYTES of text. Inside
a block every distinct word gets a code (its order of first appearance), so a
document is its list of codes by position, and the shuffles that follow move a
block's distinct words instead of all words of all documents. Words go out in
PARTS hash parts; each (block, part) row carries its words packed together, so
a word meets one task with one entry per block, however frequent it is.

Rows: block, part, key, n, data. part -1 is a document (key: its id, n: number
of words, data: codes), -2 the block's header (the part of every code), 0 and
up a part's words in code order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 16 << 20
DOC, HEAD = -1, -2
SCHEMA = "block long, part int, key long, n long, data binary"
ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

squeeze, stretch = zstandard.compress, zstandard.decompress


def pack(items: list[bytes]) -> bytes:
    """Lengths, then the joined bytes."""
    return squeeze(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items))


def unpack(data: bytes) -> list[bytes]:
    raw = stretch(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def pack_numbers(values) -> bytes:
    return squeeze(np.asarray(values, "<u4").tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(stretch(data), "<u4")


def part_of(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


class _Block:
    def __init__(self, number: int, parts: int, weigh: bool):
        self.number, self.parts, self.weigh = number, parts, weigh
        self.codes: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.size, self.weights = 0, []

    def add(self, key, words: list[bytes], size: int, weight: int) -> None:
        known = self.codes
        codes = np.array([known.setdefault(w, len(known)) for w in words], "<u4")
        self.rows.append((self.number, DOC, key, len(words), squeeze(codes.tobytes())))
        if self.weigh and weight:
            self.weights.append(codes)
        self.size += size + 64

    def batch(self) -> pa.RecordBatch:
        words = list(self.codes)
        parts = np.fromiter((part_of(w, self.parts) for w in words), "<u4", len(words))
        rows = [*self.rows, (self.number, HEAD, None, len(words), pack_numbers(parts))]
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order])) + 1
        counts = np.bincount(np.concatenate([*self.weights, np.empty(0, "<u4")]).astype(np.int64), minlength=len(words))
        for group in np.split(order, cuts):
            if len(group):
                items = [words[i] for i in group.tolist()]
                if self.weigh:
                    items.append(counts[group].astype("<u4").tobytes())
                rows.append((self.number, int(parts[group[0]]), None, len(group), pack(items)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def to_blocks(docs: DataFrame, key: str, text: str, tokenize: Callable[[str], list[bytes]], parts: int,
              weight: Callable[[object], int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Block rows of a table. With `weight`, a part's packed words are followed
    by how often each occurs in the documents whose key has weight 1."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        at, block = 0, _Block(first, parts, weight is not None)
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                k, t = k.as_py(), t.as_py() or ""
                block.add(k, tokenize(t), len(t), weight(k) if weight else 0)
                if block.size >= block_bytes:
                    yield block.batch()
                    at += 1
                    block = _Block(first + at, parts, weight is not None)
        if block.rows:
            yield block.batch()

    return docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).mapInArrow(cut, SCHEMA)


def word_rows(blocks: DataFrame) -> DataFrame:
    """The rows of words alone. The selection is made in the task, so that the
    exchange of the blocks below stays the same for all its readers."""
    def keep(batches):
        for batch in batches:
            mask = pa.compute.greater_equal(batch.column(1), 0)
            yield batch.filter(mask)

    return blocks.mapInArrow(keep, SCHEMA)


class OpenBlock:
    """A block's rows in one Arrow table, read back."""

    def __init__(self, table: pa.Table):
        part = table.column("part").to_numpy()
        self.docs = np.flatnonzero(part == DOC)
        self.keys, self.data = table.column("key"), table.column("data")
        self.head = int(np.flatnonzero(part == HEAD)[0])
        self.part, self.all = part, table

    def code_parts(self) -> np.ndarray:
        return unpack_numbers(self.data[self.head].as_py())

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        for i in self.docs.tolist():
            yield self.keys[i].as_py(), unpack_numbers(self.data[i].as_py())

    def by_code(self, rows: Iterable[tuple[int, list]]) -> list:
        """Put per-part lists back into code order."""
        parts = self.code_parts()
        order = np.argsort(parts, kind="stable").tolist()
        out: list = [None] * len(parts)
        values = [x for _, items in sorted(rows, key=lambda r: r[0]) for x in items]
        for i, x in zip(order, values, strict=True):
            out[i] = x
        return out


def n_parts(df: DataFrame) -> int:
    """Word parts: four for each shuffle partition, so that parts spread evenly."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
