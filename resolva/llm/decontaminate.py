"""Benchmark decontamination by word n-grams.

Benchmark items and documents are normalised alike: A-Z lower-cased, words are
runs of 0-9, a-z and every character outside ASCII. Every window of N
consecutive item words (an item of fewer is one window) goes into a hash set of
distinct windows, which is broadcast when its counted size allows and joined by
hash otherwise. Documents are scanned window by window; a hash hit is verified
by comparing the words themselves. A document word inside any verified window
is hit.

Defined results: null and empty texts have no words and no hits; an item
without words has no window; equal items all count; repeated documents and
documents with null or equal ids are judged on their own (rows carry a written
row id); extra columns are carried; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh, let, with_row_id

N = 10
#: The window table is broadcast up to this many rows (about 100 bytes each).
BROADCAST_WINDOWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def _windows(words: Column, n: int) -> Column:
    """(pos from 1, length, hash) of all windows of n words."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice(words, i, n)).alias("hash"))))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """Distinct windows (hash, words) with the items that have them."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    spans = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.slice("w", i, n))
                   ).otherwise(F.array(F.col("w")))
    return (items.select("item", F.explode(spans).alias("words"))
            .groupBy("words").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("words").alias("hash"), "words", "items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", n: int = N,
              keep: list[str] | None = None) -> DataFrame:
    """Add n_words, hit_spans (array of start and end word, from 1, merged),
    n_hit and items (sorted as strings) to every row, as the last columns, under
    other names where the carried columns have these. `keep` names the columns
    to carry, all by default."""
    keep = list(docs.columns) if keep is None else keep
    rid, words, found, n_words, hit_spans, n_hit, its = fresh(docs, "row_id", "words", "found", "n_words", "hit_spans", "n_hit", "items")
    rows = with_row_id(docs.select(*keep, *([text] if text not in keep else [])), rid, "decontaminate")
    windows = benchmark_windows(benchmark, item, text, n).persist()
    # one pass over the benchmark gives the size and the (at most n) window lengths
    size = windows.groupBy(F.size("words").alias("len")).count().collect()
    lengths = sorted(r["len"] for r in size)
    scanned = rows.withColumn(words, words_of(F.col(text)))
    if not lengths:
        return scanned.select(*keep, F.size(words).cast("long").alias(n_words),
                              F.array().cast("array<struct<start:int,end:int>>").alias(hit_spans),
                              F.lit(0).cast("long").alias(n_hit), F.array().cast("array<string>").alias(its))
    grams = F.col(words)
    grams = let(grams, lambda w: F.flatten(F.filter(F.array(*[_windows(w, k) for k in lengths]), lambda a: a.isNotNull())))
    at = scanned.select(F.col(rid), F.explode(grams).alias("g")).select(rid, "g.pos", "g.len", "g.hash")
    small = sum(r["count"] for r in size) <= BROADCAST_WINDOWS
    table = windows.withColumnRenamed("hash", "window_hash")
    table = F.broadcast(table) if small else table
    hits = (at.join(table, (F.col("hash") == F.col("window_hash")) & (F.col("len") == F.size("words")))
            .groupBy(rid).agg(F.collect_list(F.struct("pos", "len", "words", "items")).alias(found)))
    joined = rows.join(hits, rid, "left").withColumn(words, words_of(F.col(text)))
    true = let(F.col(words), lambda w: F.filter(
        F.coalesce(F.col(found), F.array().cast(hits.schema[found].dataType)),
        lambda h: F.slice(w, h["pos"], h["len"]) == h["words"]))
    judged = joined.withColumn(found, true)
    spans = F.aggregate(
        F.array_sort(F.transform(found, lambda h: F.struct(h["pos"].alias("start"), (h["pos"] + h["len"] - 1).alias("end")))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))))
    judged = judged.withColumn(hit_spans, spans)
    return judged.select(
        *keep, F.size(words).cast("long").alias(n_words), hit_spans,
        F.aggregate(hit_spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1).alias(n_hit),
        F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda h: h["items"])))).alias(its))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drop documents with any hit; columns stay."""
    out = find_hits(docs, benchmark)
    return out.filter(F.col(out.columns[-2]) == 0).select(*docs.columns)
