"""Language-model scores from a log-bilinear model trained by noise contrast.

Words fall into classes: each of the TOP most frequent training words is a
class of its own, the others share BUCKETS hash classes. The model predicts a
token's class from the two tokens before it, log-bilinearly: the target's
vector times the sum of the context vectors, weighted by position, plus a
bias. It is trained in numpy with noise-contrastive estimation, one pass over
all training tokens: every block trains from the same start, and the blocks'
parameters are averaged in a tree. Scores are normalised exactly: the
normaliser of every pair of context classes comes out of one product of two
matrices. Inside a hash class a word has its smoothed share of the class's
corpus count, so counts of all words are gathered, by word, and joined back.

Defined results: a null text is the empty text (one end token); a null key is
the text `null` for the fold; repeated rows are scored alike; with no training
rows the model stays at its start; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolva.llm import blocks as B
from resolva.llm.common import materialize

TOP, BUCKETS, DIM = 1024, 512, 32
NOISE, BATCH, RATE = 128, 4096, 0.05
END = b" "  # no word has a space
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens_of(text: str) -> list[bytes]:
    words = text.encode().translate(LOWER).split()
    words.append(END)
    return words


def fold(key) -> int:
    return zlib.crc32(("null" if key is None else str(key)).encode()) % 5


def class_of(word: bytes, top: dict[bytes, int]) -> int:
    i = top.get(word)
    return TOP + zlib.crc32(word, 1) % BUCKETS if i is None else i


def start(class_counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    v = len(class_counts)
    p = (class_counts + 0.5) / (class_counts + 0.5).sum()
    return {"r": rng.normal(0, 0.1, (v, DIM)).astype("f4"), "q": rng.normal(0, 0.1, (v, DIM)).astype("f4"),
            "c": np.ones((2, DIM), "f4"), "b": np.log(p).astype("f4")}


def _gather(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of rows by index."""
    out = np.zeros((size, *rows.shape[1:]), "f4")
    order = np.argsort(index, kind="stable")
    at = index[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[cuts]] = np.add.reduceat(rows[order], cuts, axis=0)
    return out


def train_block(model: dict[str, np.ndarray], noise: np.ndarray, seq: np.ndarray, prev: np.ndarray, prev2: np.ndarray,
                seed: int) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive steps (AdaGrad); the noise words of a step are shared."""
    rng = np.random.default_rng(seed)
    m = {k: x.copy() for k, x in model.items()}
    seen = {k: np.full_like(x, 1e-8) for k, x in m.items()}
    v, logn = len(noise), np.log(noise * NOISE).astype("f4")
    cdf = np.cumsum(noise)
    order = rng.permutation(len(seq))
    for a in range(0, len(seq), BATCH):
        at = order[a:a + BATCH]
        w, w1, w2 = seq[at], prev[at], prev2[at]
        k = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), v - 1)
        r1, r2 = m["r"][w1], m["r"][w2]
        h = r1 * m["c"][0] + r2 * m["c"][1]
        qw, qk = m["q"][w], m["q"][k]
        gw = 1 - 1 / (1 + np.exp(np.clip(logn[w] - m["b"][w] - (h * qw).sum(1), -30, 30)))       # true: pull up
        gk = -1 / (1 + np.exp(np.clip(logn[k] - m["b"][k] - h @ qk.T, -30, 30)))                 # noise: push down
        gh = gw[:, None] * qw + gk @ qk
        n = np.float32(1 / len(at))
        both = np.concatenate([w, k])
        grad = {
            "q": _gather(both, np.concatenate([gw[:, None] * h, gk.T @ h]), v),
            "b": _gather(both, np.concatenate([gw, gk.sum(0)])[:, None], v)[:, 0],
            "r": _gather(np.concatenate([w1, w2]), np.concatenate([gh * m["c"][0], gh * m["c"][1]]), v),
            "c": np.stack([(gh * r1).sum(0), (gh * r2).sum(0)]),
        }
        for name, g in grad.items():
            g = g * n
            seen[name] += g * g
            m[name] += RATE * g / np.sqrt(seen[name])
    return m


def log_normaliser(m: dict[str, np.ndarray]) -> np.ndarray:
    """log of the sum over all classes, for every pair (w1, w2) of contexts."""
    one, two = (m["r"] * m["c"][0]) @ m["q"].T, (m["r"] * m["c"][1]) @ m["q"].T
    top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
    total = (np.exp(one - top1) * np.exp(m["b"])) @ np.exp(two - top2).T
    return (np.log(np.maximum(total, 1e-30)) + top1 + top2.T).astype("f4")


def _sequences(block: B.OpenBlock, classes: np.ndarray, end: int, wanted=lambda key: True):
    """Per document: key, codes, classes and the classes one and two before."""
    for key, codes in block.documents():
        if wanted(key):
            seq = classes[codes]
            lead = np.concatenate([np.array([end, end], seq.dtype), seq])
            yield key, codes, seq, lead[1:-1], lead[:-2]


def _words(table: pa.Table) -> list[bytes]:
    block = B.OpenBlock(table)
    part, data = block.part, block.data
    return block.by_code((int(part[i]), B.unpack(data[i].as_py())[:-1]) for i in np.flatnonzero(part >= 0).tolist())


def _merged(frame: DataFrame, merge, schema: str, tag: str, fan: int = 64) -> DataFrame:
    """At most one row: groups of about `fan` rows are merged until one is left."""
    frame = materialize(frame, tag)
    while (left := frame.count()) > 1:
        groups = (left + fan - 1) // fan
        frame = materialize(frame.withColumn("g", F.pmod(F.xxhash64(frame.columns[0]), F.lit(groups))).groupBy("g").applyInArrow(
            lambda t: merge(t.drop_columns(["g"])), schema), tag)
    return frame


def count_words(blocks: DataFrame, top: int = TOP) -> tuple[dict[bytes, int], dict]:
    """The most frequent training words in order, and corpus totals. A part's
    words meet in one task, one entry per block and word; a part passes on one
    row, with its own top words and its totals by hash class, and these rows are
    merged in a tree."""
    def packed(part: int, words: list[bytes], counts: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> pa.Table:
        best = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))[:top]
        data = B.pack([*(words[i] for i in best), counts[best].astype("<i8").tobytes(), total.tobytes(), distinct.tobytes()])
        return pa.table([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    def opened(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        *words, counts, total, distinct = B.unpack(data)
        return words, *(np.frombuffer(x, "<i8") for x in (counts, total, distinct))

    def count(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        for d in table.column("data"):
            *words, counts = B.unpack(d.as_py())
            for w, c in zip(words, np.frombuffer(counts, "<u4").tolist()):
                if c:
                    seen[w] = seen.get(w, 0) + c
        total, distinct = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for w, c in seen.items():
            total[zlib.crc32(w, 1) % BUCKETS] += c
            distinct[zlib.crc32(w, 1) % BUCKETS] += 1
        return packed(table.column("part")[0].as_py(), list(seen), np.array(list(seen.values()), np.int64), total, distinct)

    def merge(table: pa.Table) -> pa.Table:
        """Parts have no word in common."""
        rows = [opened(d.as_py()) for d in table.column("data")]
        return packed(table.column("part")[0].as_py(), [w for r in rows for w in r[0]], np.concatenate([r[1] for r in rows]),
                      sum(r[2] for r in rows), sum(r[3] for r in rows))

    schema = "part int, data binary"
    last = _merged(blocks.filter("part >= 0").groupBy("part").applyInArrow(count, schema), merge, schema, "lm-counts").collect()
    none = np.zeros(0, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    words, counts, total, distinct = opened(bytes(last[0]["data"])) if last else ([], *none)
    stats = {"N": int(total.sum()), "V": int(distinct.sum())}
    total, distinct = total.copy(), distinct.copy()
    for w, c in zip(words, counts.tolist()):
        total[zlib.crc32(w, 1) % BUCKETS] -= c
        distinct[zlib.crc32(w, 1) % BUCKETS] -= 1
    top_counts = np.zeros(top, np.int64)
    top_counts[:len(words)] = counts
    return {w: i for i, w in enumerate(words)}, stats | {
        "classes": np.concatenate([top_counts, total]), "bucket_total": total, "bucket_v": distinct}


def train(blocks: DataFrame, top: dict[bytes, int], stats: dict, fan: int = 64) -> dict[str, np.ndarray]:
    """Train every block from the same start and average, weighted by tokens."""
    classes = stats["classes"]
    begin = start(classes)
    noise = (classes + 0.5) / (classes + 0.5).sum()
    shared = blocks.sparkSession.sparkContext.broadcast((begin, noise, top))

    def run(table: pa.Table) -> pa.Table:
        model, p, known = shared.value
        words = np.array([class_of(w, known) for w in _words(table)], np.int64)
        end = class_of(END, known)
        got = [x[2:] for x in _sequences(B.OpenBlock(table), words, end, lambda k: fold(k) != 1)]
        n = sum(len(x[0]) for x in got)
        if not n:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["block", "n", "model"])
        seq, w1, w2 = (np.concatenate(x) for x in zip(*got))
        block = table.column("block")[0].as_py()
        m = train_block(model, p, seq, w1, w2, block % (1 << 31))
        return pa.table([pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([pickle.dumps(m)], pa.binary())],
                        names=["block", "n", "model"])

    def average(table: pa.Table) -> pa.Table:
        total, out = 0, None
        for n, data in zip(table.column("n"), table.column("model")):
            m, n = pickle.loads(data.as_py()), n.as_py()
            out = {k: n * x.astype("f8") for k, x in m.items()} if out is None else {k: out[k] + n * x for k, x in m.items()}
            total += n
        out = {k: (x / total).astype("f4") for k, x in out.items()}
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([total], pa.int64()),
                         pa.array([pickle.dumps(out)], pa.binary())], names=["block", "n", "model"])

    schema = "block long, n long, model binary"
    last = _merged(blocks.groupBy("block").applyInArrow(run, schema), average, schema, "lm-models", fan).collect()
    return pickle.loads(bytes(last[0]["model"])) if last else begin  # one row of fixed size, or none


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigram) and score (the model), log10."""
    blocks = materialize(B.to_blocks(docs, key, text, tokens_of, B.n_parts(docs), lambda k: int(fold(k) != 1), block_bytes), "lm-blocks")
    top, stats = count_words(blocks)
    model = train(blocks, top, stats)
    norm = log_normaliser(model)
    shared = docs.sparkSession.sparkContext.broadcast((model, norm, top, stats))

    def totals(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        kept = []
        for d in table.column("data"):
            *words, counts = B.unpack(d.as_py())
            kept.append(words)
            for w, c in zip(words, np.frombuffer(counts, "<u4").tolist()):
                seen[w] = seen.get(w, 0) + c
        data = [B.squeeze(np.array([seen[w] for w in words], "<u8").tobytes()) for words in kept]
        return table.set_column(4, "data", pa.array(data, pa.binary()))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        m, z, known, st = shared.value
        block = B.OpenBlock(left)
        c = np.array(block.by_code((p.as_py(), np.frombuffer(B.stretch(d.as_py()), "<u8").tolist())
                                   for p, d in zip(right.column("part"), right.column("data"))), "f8")
        cls = np.array([class_of(w, known) for w in _words(left)], np.int64)
        n, v = st["N"], st["V"]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        total = np.concatenate([np.zeros(TOP), st["bucket_total"]])[cls]
        distinct = np.concatenate([np.zeros(TOP), st["bucket_v"]])[cls]
        inside = np.where(cls < TOP, 0.0, np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))))
        out = []
        for k, codes, seq, w1, w2 in _sequences(block, cls, class_of(END, known)):
            s = 0.0
            for a in range(0, len(seq), 1 << 16):
                b = slice(a, a + (1 << 16))
                h = m["r"][w1[b]] * m["c"][0] + m["r"][w2[b]] * m["c"][1]
                logp = np.einsum("ij,ij->i", h, m["q"][seq[b]]) + m["b"][seq[b]] - z[w1[b], w2[b]]
                s += float(logp.sum(dtype="f8")) / np.log(10)
            out.append((k, fold(k) == 1, len(codes), int((c[codes] > 0).sum()), n, float(base[codes].sum()),
                        s + float(inside[codes].sum())))
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)],
                        names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    counted = blocks.filter("part >= 0").groupBy("part").applyInArrow(totals, B.SCHEMA)
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        rate, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
