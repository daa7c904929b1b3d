"""N-gram Jaccard self-join with a MinHash LSH forest.

A text is the set of its five-word shingles (words are white-space separated,
lower-cased; a text of one to four words is one shingle). Every tree of the
forest labels a set with K_MAX MinHash values; sorted labels form a prefix
trie. Matching starts at the full label and shortens the matched prefix until
the forest's recall at the threshold, 1 - (1 - t^depth)^trees, reaches TARGET.
Sets that share a prefix of that depth in any tree are candidates; candidates
are verified exactly on their shingle sets.

Skew: rows with equal shingle sets collapse to one representative first.
Candidate groups are components over trie buckets, computed on ids alone, so a
text is shuffled once to its group. Groups of more than CHUNK members are cut
into hash chunks and verified chunk pair by chunk pair; small groups share a
task. A task returns each member's number of links and a spanning set of
edges, never the pairs.

Defined results: texts without words (null, empty) link with nothing; repeated
rows and null ids are rows of their own (rows carry a written row id); an empty
table gives no rows; extra columns are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh, materialize, with_row_id
from resolva.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, K_MAX, TARGET = 16, 8, 0.99
CHUNK, BIN_ROWS = 1024, 2000

_rng = np.random.default_rng(11)
MULTIPLY = _rng.integers(1, 1 << 63, TREES * K_MAX, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, TREES * K_MAX, dtype=np.uint64)
POWERS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


class WordHash(dict):
    """64-bit hashes of words, kept for the words of late."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        out += (h[j:j + n] ^ (h[j:j + n] >> np.uint64(29))) * POWERS[j]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def labels(s: np.ndarray) -> np.ndarray:
    """TREES x K_MAX MinHash values, 32 bits each."""
    best = np.full(TREES * K_MAX, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 8192):
        best = np.minimum(best, (s[a:a + 8192, None] * MULTIPLY + ADD).min(0))
    return (best >> np.uint64(32)).reshape(TREES, K_MAX)


def depth_for(threshold: float, trees: int = TREES, target: float = TARGET) -> int:
    """Shorten the matched prefix until the forest's recall is reached."""
    depth = K_MAX
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def sign(rows: DataFrame, row: str, text: str, depth: int) -> DataFrame:
    """(row, key, prefixes): a digest of the shingle set and, for every tree,
    the hash of the label's first `depth` values. Rows without words are left out."""
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            ids, keys, prefixes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(t.as_py(), hashes)
                if len(s):
                    ids.append(i)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefixes.append([xxhash.xxh64_intdigest(p.tobytes(), seed=k) - (1 << 63)
                                     for k, p in enumerate(labels(s)[:, :depth])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(prefixes, pa.list_(pa.int64()))], names=["row", "key", "prefixes"])

    return rows.select(F.col(row), F.col(text).cast("string")).mapInArrow(run, "row long, key binary, prefixes array<long>")


def _similar(sets: list[np.ndarray], allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the allowed pairs whose exact Jaccard similarity reaches the threshold."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    both = np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - 1e-9
    allowed = allowed & both
    common = np.zeros((m, m), "f4")
    pairs = np.argwhere(np.triu(allowed, 1))
    if len(pairs) <= 4 * m:
        as_sets = {i: set(sets[i].tolist()) for i in np.unique(pairs).tolist()}
        for i, j in pairs.tolist():
            common[i, j] = common[j, i] = len(as_sets[i] & as_sets[j])
    else:  # incidence of the shared shingles, some columns at a time
        owner = np.repeat(np.arange(m), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(1024, (1 << 24) // max(m, 1))
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            matrix = np.zeros((m, min(width, int(column[-1]) + 1 - a)), "f4")
            matrix[owner[lo:hi], column[lo:hi] - a] = 1
            common += matrix @ matrix.T
    union = size[:, None] + size - common
    return allowed & (common >= threshold * union - 1e-6)


def _verify_group(reps, chunks, sizes, prefixes, sets, crossing: bool, threshold: float):
    """Links of the members of one candidate group, or of one pair of chunks."""
    m = len(reps)
    allowed = np.zeros((m, m), bool)
    for t in range(TREES):
        allowed |= prefixes[:, t][:, None] == prefixes[:, t]
    if crossing:
        allowed &= chunks[:, None] != chunks
    np.fill_diagonal(allowed, False)
    linked = _similar(sets, allowed, threshold)
    edges, parent = [], list(range(m))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            edges.append((int(reps[i]), int(reps[j])))
    return linked @ sizes, linked.sum(1), edges


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """members: rep, root, chunk, crossing, g1, g2, g3, size, prefixes, text →
    (rep, links, texts, other): link counts of a representative, or an edge."""
    def run(table: pa.Table) -> pa.Table:
        hashes, out = WordHash(), []
        root = table.column("root").to_numpy()
        order = np.argsort(root, kind="stable")
        table, root = table.take(order), root[order]
        prefixes = np.array(table.column("prefixes").to_pylist(), np.int64).reshape(-1, TREES)
        reps, chunks, sizes = (table.column(c).to_numpy() for c in ("rep", "chunk", "size"))
        crossing = bool(table.column("g2")[0].as_py() != table.column("g3")[0].as_py())
        texts = table.column("text")
        starts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
        for a, b in zip(starts, starts[1:]):
            sets = [shingles(texts[i].as_py(), hashes) for i in range(a, b)]
            links, kinds, edges = _verify_group(reps[a:b], chunks[a:b], sizes[a:b], prefixes[a:b], sets, crossing, threshold)
            out += [(int(r), int(n), int(k), None) for r, n, k in zip(reps[a:b], links, kinds) if k]
            out += [(x, 0, 0, y) for x, y in edges]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))],
                        names=["rep", "links", "texts", "other"])

    return members.groupBy("g1", "g2", "g3").applyInArrow(run, "rep long, links long, texts long, other long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str, DataFrame]:
    """The rows with a written row id, that column's name, and for every row
    with words (row, class_row, n_links, n_texts): the least row of its class,
    the number of rows it is linked with, and of different texts among them."""
    (row,) = fresh(docs, "row_id")
    rows = with_row_id(docs, row, "neardup")
    signed = materialize(sign(rows, row, text, depth_for(threshold)), "neardup-signed")
    classes = materialize(signed.groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"),
                                                    F.first("prefixes").alias("prefixes")), "neardup-classes")
    buckets = classes.select("rep", F.explode("prefixes").alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    groups = components(buckets.join(stars, "bucket").select(F.col("rep").alias("a"), F.col("least").alias("b")), "neardup-groups")
    groups = materialize(groups, "neardup-groups")
    counts = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    total = groups.count()
    bins = total // BIN_ROWS + 1
    members = (groups.join(counts, "root").withColumnRenamed("node", "rep").join(classes.drop("key"), "rep")
               .withColumn("cuts", F.ceil(F.col("m") / CHUNK).cast("int"))
               .withColumn("chunk", F.expr("pmod(xxhash64(rep), cuts)").cast("int"))
               .join(rows.select(F.col(row).alias("rep"), F.col(text).cast("string").alias("text")), "rep"))
    members = members.withColumn("pair", F.explode(F.expr("sequence(0, cuts - 1)"))).select(
        "rep", "root", "chunk", "size", "prefixes", "text",
        F.when(F.col("cuts") == 1, -1 - F.expr(f"pmod(xxhash64(root), {bins})")).otherwise(F.col("root")).alias("g1"),
        F.least("chunk", "pair").alias("g2"), F.greatest("chunk", "pair").alias("g3"))
    found = materialize(verify(members, threshold), "neardup-links")
    links = found.filter("other is null").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "neardup-classes")
    ranked = (signed.select("row", "key").join(classes.select("key", "rep", "size"), "key").drop("key")
              .join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .select("row", F.coalesce("root", "rep").alias("class_row"),
                      (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts")))
    return rows, row, ranked


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, class_id (least key of the class), n_links, n_texts."""
    rows, row, ranked = join(docs.select(key, text), key, text, threshold)
    out = rows.select(row, key).join(ranked, F.col(row) == F.col("row"), "left").select(
        key, F.coalesce("class_row", row).alias("class_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))
    out = materialize(out, "neardup-out")
    firsts = out.groupBy("class_row").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return out.join(firsts, "class_row").select(key, "class_id", "class_size", "n_links", "n_texts")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Drop every row but the first, by (key, row), of each class; columns stay."""
    rows, row, ranked = join(docs, key, text, threshold)
    keyed = ranked.filter("n_links > 0").join(rows.select(F.col(row).alias("row"), F.col(key).alias("k")), "row")
    firsts = keyed.groupBy("class_row").agg(F.min(F.struct("k", "row")).alias("first"))
    dropped = keyed.join(firsts, "class_row").filter("row <> first.row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)
