"""BPE with word ends over content-defined chunks that documents share.

A rolling hash over the last WINDOW bytes cuts every text where the content
says so, so equal passages of different documents yield equal chunks. A scan
task cuts its documents into blocks, which keep each distinct chunk once and
are dealt by block. Only the chunks' 16-byte names go on to hash parts; a part
finds the names that several blocks hold and picks one holder per name (one for
every LENT holders of a very common chunk), which encodes the chunk and lends
the ids to the other holders. A block then encodes what is only its own and
puts its documents together. So texts move once and shared chunks are encoded
once, while ids move for shared chunks alone.

Cuts fall anywhere, also inside words, so a chunk's first and last tokens may
be wrong. A chunk's head (up to a white-space character) and tail (from one)
are encoded alone; where both agree exactly with the ends of the whole chunk's
ids the borders hold, else they move inwards to the next white space, and a
chunk without such borders stays open as a whole. Joins are then repaired by
re-encoding tail and head (and open chunks between them) as one text. This is
exact for tokenizers that drop white space: nothing composes with a white-space
character before it, and no token or special token reaches over one.

Memory: one block of documents in a task and the ids of at most KEPT_WORDS words,
or one part's names, a name for each block that holds the chunk. Chunk codes follow the order of the rows in a scan
task; a frame with a shuffle is therefore written first.

Defined results: a null text is the empty text and has no ids; null and
repeated keys stay rows of their own; an empty table gives no rows; other
columns are not read. Special-token strings in a text become their ids, as the
tokenizer has it. An id outside the vocabulary is an error in decoding.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from resolva.llm import blocks as B
from resolva.llm.common import materialize

WINDOW, LEAST, MEAN, MOST = 32, 128, 512, 4096
BLOCK_BYTES = 8 << 20
LENT = 1024
KEPT_WORDS = 300_000
MULTIPLIER = 0x9E3779B1
SPACES = " \t\n\x0b\x0c\r"

BLOCK = "block long, keys array<long>, counts binary, codes binary, chunks binary"
NAMES = "part int, block long, codes binary, names binary"
LOANS = "block long, codes binary, holders binary, places binary"
ITEMS = "block long, codes binary, items binary"
BINARY = pa.binary()


def cut_chunks(data: bytes) -> list[bytes]:
    """Cut UTF-8 text where the rolling hash has its mark, LEAST to MOST bytes
    apart and never inside a character."""
    if len(data) <= LEAST:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    h = (raw.astype(np.uint32) + np.uint32(1)) * np.uint32(MULTIPLIER)
    width, power = 1, MULTIPLIER
    while width < WINDOW:       # h[i]: hash of the `width` bytes that end at i
        h[width:] = h[width:] + h[:-width] * np.uint32(power)
        width, power = 2 * width, power * power & 0xFFFFFFFF
    marks = np.flatnonzero((h[:-1] >> np.uint32(16)) & np.uint32(MEAN - 1) == 0) + 1
    marks = marks[(raw[marks] & 0xC0) != 0x80].tolist()
    out, last = [], 0
    for mark in [*marks, len(data)]:
        while mark - last > MOST:
            stop = last + MOST
            while raw[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(data[last:stop])
            last = stop
        if mark - last >= LEAST or mark == len(data):
            out.append(data[last:mark])
            last = mark
    return [c for c in out if c]


#: Printable ASCII, plain white space and common Latin letters: composed
#: already, and with the same classes and lower case in every Unicode version.
PLAIN_CHARACTERS = "\t\n\r" + "".join(map(chr, [*range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x180)]))
PLAIN = re.compile(f"[{re.escape(PLAIN_CHARACTERS)}]*")


def _of_category(letter: str) -> str:
    return "".join(re.escape(c) for c in PLAIN_CHARACTERS if unicodedata.category(c)[0] == letter)


def word_rule(spec: str) -> tuple[re.Pattern, list[str]] | None:
    """The pattern whose matches in lower-cased text the tokenizer encodes one by
    one, spelled for PLAIN characters, and its special tokens; None if the
    tokenizer does anything else."""
    parts = json.loads(spec)
    normal = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    plain = (split.get("type"), split.get("behavior"), split.get("invert"), [x["type"] for x in rest]) == ("Split", "Removed", True, ["ByteLevel"])
    if normal != ["NFC", "Replace", "Lowercase"] or not plain or parts["post_processor"] or parts["model"]["type"] != "BPE":
        return None
    pattern = split["pattern"]["Regex"].replace(r"\p{L}", _of_category("L")).replace(r"\p{N}", _of_category("N"))
    return None if r"\p" in pattern else (re.compile(pattern), [x["content"] for x in parts["added_tokens"]])


def byte_letters() -> dict[int, str]:
    """The letters that stand for a character's UTF-8 bytes in a byte-level
    vocabulary: visible Latin-1 bytes stand for themselves, the others, in
    order, for the code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in PLAIN_CHARACTERS.lower()}


class _Words(dict):
    """Ids of words, merged once when a word is first asked for."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.letters = tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.tokenize(word if word.isascii() else word.translate(self.letters))], "<u4").tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """The tokenizer inside a task. Texts of PLAIN characters are cut into words
    here and each distinct word is merged once; other texts go to the tokenizer
    as they are."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks are the parallelism
        self.model = tokenizers.Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.rule = word_rule(spec)
        self.words = _Words(self.model.model.tokenize)
        self.tokens: dict[int, str] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if self.rule is None:
            return self.whole(texts)
        cut, special = self.rule[0].findall, self.rule[1]
        plain, word, out, other = PLAIN.fullmatch, self.words.__getitem__, [], []
        for i, t in enumerate(texts):
            if plain(t) and not ("<" in t and any(s in t for s in special)):
                out.append(b"".join(map(word, cut(t.lower()))))
            else:
                out.append(b"")
                other.append(i)
        for i, ids in zip(other, self.whole([texts[i] for i in other])):
            out[i] = ids
        return out

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Per chunk: numbers of head and tail tokens, head, tail and ids."""
        texts = [c.decode() for c in chunks]
        whole = self(texts)
        done = [b""] * len(texts)
        skip, todo = 0, range(len(texts))
        while todo:
            ends, still = {}, []
            for i in todo:
                if (pair := _borders(texts[i], skip)) is None:
                    done[i] = _item(None, texts[i], "", whole[i])
                else:
                    ends[i] = pair
            pieces = list({p for pair in ends.values() for p in pair})
            known = dict(zip(pieces, self(pieces)))
            for i, (head, tail) in ends.items():
                if whole[i].startswith(known[head]) and whole[i].endswith(known[tail]):
                    done[i] = _item((len(known[head]) // 4, len(known[tail]) // 4), head, tail, whole[i])
                else:
                    still.append(i)
            skip, todo = 2 * skip + 1, still
        return done

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, for tokenizers without a decoder of their own."""
        if not self.tokens:
            vocabulary = self.model.get_vocab(with_added_tokens=True)
            self.tokens = dict(zip(vocabulary.values(), vocabulary))
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


SPACE = re.compile(f"[{SPACES}]")


def _borders(text: str, skip: int) -> tuple[str, str] | None:
    """Head and tail of a text, at the white-space characters that have `skip`
    others before or behind them; None where they would cross."""
    first = SPACE.search(text)
    if first is None:
        return None
    if not skip:
        a, b = first.start(), max(text.rfind(c) for c in SPACES)
    else:
        places = [m.start() for m in SPACE.finditer(text)]
        if 2 * skip >= len(places):
            return None
        a, b = places[skip], places[-1 - skip]
    return text[:a], text[b:]


OPEN = 0xFFFFFFFF


def _item(ends: tuple[int, int] | None, head: str, tail: str, ids: bytes) -> bytes:
    h, t = head.encode(), tail.encode()
    return struct.pack("<4I", *(ends or (OPEN, OPEN)), len(h), len(t)) + h + t + ids


class Chunk:
    """An encoded chunk, read back: its ids, and its ids without head or tail."""
    __slots__ = ("open", "head", "tail", "ids", "start", "stop")

    def __init__(self, item: bytes):
        n_head, n_tail, h, t = struct.unpack_from("<4I", item)
        self.open = n_head == OPEN
        self.head, self.tail = item[16:16 + h].decode(), item[16 + h:16 + h + t].decode()
        self.ids = item[16 + h + t:]
        self.start, self.stop = (0, 0) if self.open else (4 * n_head, len(self.ids) - 4 * n_tail)


def _pieces(chunks: list[Chunk]) -> list[bytes | str]:
    """A document as ids that hold and texts of joins that must be encoded."""
    out: list[bytes | str] = []
    text, last = "", len(chunks) - 1
    for i, c in enumerate(chunks):
        if c.open and last:
            text += c.head
            continue
        if i:
            out.append(text + c.head)
        out.append(c.ids[c.start if i else 0:c.stop if i < last else len(c.ids)])
        text = c.tail if i < last else ""
    return [*out, text] if text else out


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": BINARY}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _numbers(column: pa.ChunkedArray, kind: str = "<u4") -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def _cut_blocks(block_bytes: int):
    """Scan task: documents as blocks, one row each."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        known, keys, counts, codes, size = {}, [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([B.pack_numbers(counts)], BINARY),
                 pa.array([B.pack_numbers(codes)], BINARY), pa.array([B.pack(list(known))], BINARY)],
                names=["block", "keys", "counts", "codes", "chunks"])

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                chunks = cut_chunks(data)
                codes.extend([known.setdefault(c, len(known)) for c in chunks])
                keys.append(k.as_py())
                counts.append(len(chunks))
                size += len(data) + 64
                if size >= block_bytes:
                    yield row()
                    number += 1
                    known, keys, counts, codes, size = {}, [], [], [], 0
        if keys:
            yield row()

    return run


def _name_chunks(parts: int):
    """Per block and part: the codes and names of the chunks that it holds."""
    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(4)):
                names = np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=16).digest() for c in B.unpack(data.as_py())]), "<u8").reshape(-1, 2)
                part = (names[:, 0] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
                columns = [[int(part[g[0]]) for g in groups], [block] * len(groups), [g.astype("<u4").tobytes() for g in groups],
                           [names[g].tobytes() for g in groups]]
                yield _table(NAMES, *columns).combine_chunks().to_batches()[0] if groups else pa.RecordBatch.from_pylist([], _table(NAMES, [], [], [], []).schema)

    return run


def _find_shared(rows: pa.Table) -> pa.Table:
    """One part's names that several blocks hold: per lending block its codes,
    and for each the block that gets the ids and the code there."""
    codes, names = _numbers(rows.column("codes")), _numbers(rows.column("names"), "<u8")
    block = np.repeat(rows.column("block").to_numpy(), [len(c) for c in codes])
    code, name = np.concatenate(codes), np.concatenate(names).reshape(-1, 2)
    order = np.lexsort((block, name[:, 1], name[:, 0]))
    block, code, name = block[order], code[order], name[order]
    first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1)))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
    size = np.diff(np.append(first, len(name)))[group]
    within = np.arange(len(name)) - first[group]
    start = first[group] + within // LENT * LENT                # holders are served LENT at a time
    many = np.minimum(LENT, first[group] + size - start)
    lender = start + (name[:, 1] % many.astype(np.uint64)).astype(np.int64)
    shared = np.flatnonzero(many > 1)
    shared = shared[np.argsort(block[lender[shared]], kind="stable")]
    owner = block[lender[shared]]
    groups = np.split(shared, np.flatnonzero(np.diff(owner)) + 1) if len(shared) else []
    return _table(LOANS, [int(block[lender[g[0]]]) for g in groups], [code[lender[g]].tobytes() for g in groups],
                  [block[g].astype("<i8").tobytes() for g in groups], [code[g].tobytes() for g in groups])


class _Once:
    """One encoder for all groups of a task."""

    def __init__(self, table):
        self.table, self.encoder = table, None

    def __call__(self) -> Encoder:
        if self.encoder is None:
            self.encoder = Encoder(self.table.value)
        return self.encoder


def _lend(table):
    """A block encodes the chunks that it lends; one row per block that gets some."""
    once = _Once(table)

    def run(block: pa.Table, loans: pa.Table) -> pa.Table:
        if not loans.num_rows or not block.num_rows:
            return _table(ITEMS, [], [], [])
        chunks = B.unpack(block.column("chunks")[0].as_py())
        codes, holders, places = (np.concatenate(_numbers(loans.column(c), k)) for c, k in (("codes", "<u4"), ("holders", "<i8"), ("places", "<u4")))
        lent, back = np.unique(codes, return_inverse=True)
        items = once().chunks([chunks[i] for i in lent.tolist()])
        order = np.argsort(holders, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(holders[order])) + 1)
        return _table(ITEMS, [int(holders[g[0]]) for g in groups], [places[g].tobytes() for g in groups],
                      [B.pack([items[i] for i in back[g].tolist()]) for g in groups])

    return run


def _assemble(table, names: list[str]):
    """Encode a block's own chunks, repair the joins, give the documents' ids
    and, with a fourth name, their decoded text."""
    once = _Once(table)

    def run(block: pa.Table, lent: pa.Table) -> pa.Table:
        keys, found = [], []
        if block.num_rows:
            keys, counts, codes, texts = (block.column(c)[0].as_py() for c in ("keys", "counts", "codes", "chunks"))
            texts = B.unpack(texts)
            items: list[bytes | None] = [None] * len(texts)
            for places, packed in zip(_numbers(lent.column("codes")), lent.column("items")):
                for i, item in zip(places.tolist(), B.unpack(packed.as_py())):
                    items[i] = item
            own = [i for i, x in enumerate(items) if x is None]
            for i, item in zip(own, once().chunks([texts[i] for i in own])):
                items[i] = item
            chunks = [Chunk(x) for x in items]
            del texts, items
            ends = np.cumsum(B.unpack_numbers(counts)).tolist()
            codes = B.unpack_numbers(codes).tolist()
            found = [_pieces([chunks[c] for c in codes[a:b]]) for a, b in zip([0, *ends], ends)]
        joins = list({p for pieces in found for p in pieces if isinstance(p, str)})
        known = dict(zip(joins, once()(joins)))
        ids = [b"".join([known[p] if isinstance(p, str) else p for p in pieces]) for pieces in found]
        columns = [pa.array(keys, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, BINARY)]
        if len(names) > 3:
            columns.append(pa.array(map(once().decode, ids) if ids else [], pa.string()))
        return pa.table(columns, names=names)

    return run


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
           decoded: str | None = None) -> DataFrame:
    """One row per document: key, n_tokens, ids (little-endian unsigned 32-bit).
    `spec` is the tokenizer's JSON text. With `decoded`, the ids are decoded in
    the same task, into a column of that name."""
    docs = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialize(docs, "chunk-docs")
    table = docs.sparkSession.sparkContext.broadcast(spec)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    blocks = docs.mapInArrow(_cut_blocks(block_bytes), BLOCK).repartition("block")
    names = blocks.mapInArrow(_name_chunks(parts), NAMES).repartition("part")
    loans = names.groupBy("part").applyInArrow(_find_shared, LOANS)
    lent = blocks.groupBy("block").cogroup(loans.groupBy("block")).applyInArrow(_lend(table), ITEMS)
    columns = [key, "n_tokens", "ids", *([decoded] if decoded else [])]
    return blocks.groupBy("block").cogroup(lent.groupBy("block")).applyInArrow(
        _assemble(table, columns), f"`{key}` long, n_tokens long, ids binary" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, spec: str, ids: str = "ids", into: str = "decoded", rows: int = 256) -> DataFrame:
    """Add the decoded text of a binary id column."""
    table = encoded.sparkSession.sparkContext.broadcast(spec)
    at = encoded.columns.index(ids)

    def run(batches):
        encoder = Encoder(table.value)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                out = [encoder.decode(x.as_py() or b"") for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, into])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(into, StringType())]))
