"""Quality rules with adaptive thresholds.

Text statistics are computed inside the row. Four ratios are then summarised
per language and source in a mergeable quantile sketch: a value falls into a
logarithmic bin (relative width GAMMA), a sketch is the count of each bin, and
sketches merge by adding counts. So a hot source costs one row per bin and
task, and the sketch of a language is the sum of its sources' sketches; a
group with fewer than MIN_ROWS documents uses its language's sketch, and a
small language the sketch of all documents.

A document passes when each ratio lies inside its group's fences, FENCE times
the spread outside the middle half of the group. The spread is the distance
between the quartiles, at least MIN_SPREAD of the ratio, so that a group of
nearly equal documents does not reject ordinary variation.

Defined results: null and empty texts have no words and fail the base rule;
null languages and sources are groups of their own; repeated rows are judged
alike; extra columns are carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh, let, materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

#: Ratio of neighbouring bin borders: quantiles are right within 1 %.
GAMMA = 1.02
#: Documents that a (language, source) sketch needs to be used on its own.
MIN_ROWS = 200
FENCE = 6.0
#: Smallest spread by ratio: hundredths of a character for word_len, else thousandths.
MIN_SPREAD = {"word_len": 40, "symbols": 25, "dup_lines": 50, "repeats": 50}
RATIOS = list(MIN_SPREAD)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more.

    Window hashes first; only a text with an equal pair goes on to sort
    (hash, position), keep positions with an equal neighbour, and add up the
    words that these windows newly cover.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(
            F.transform(s, lambda x, i: F.struct(
                x["i"].alias("i"),
                (F.get(s, i - 1)["h"] == x["h"]).alias("prev"),
                (F.get(s, i + 1)["h"] == x["h"]).alias("next"))),
            lambda x: F.coalesce(x["prev"], F.lit(False)) | F.coalesce(x["next"], F.lit(False))), lambda x: x["i"]))
        return F.aggregate(
            F.array_sort(twice), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("sum"), i.alias("last")),
            lambda acc: acc["sum"])

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def _stats(text: Column) -> Column:
    """Struct of the text statistics; words and lines are bound once."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_stats = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    word_stats = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    return let(F.struct(word_stats.alias("w"), line_stats.alias("l")), lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        x["l"]["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"),
        x["l"]["n_lines"].alias("n_lines")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PCT * n_words)


def _ratios(q: Column) -> dict[str, Column]:
    """Integer ratios of documents that passed the base rule."""
    return {
        "word_len": F.floor(100 * q["word_chars"] / q["n_words"]),
        "symbols": F.floor(1000 * q["n_symbols"] / q["n_words"]),
        "dup_lines": F.floor(1000 * q["n_dup_lines"] / q["n_lines"]),
        "repeats": F.floor(1000 * q["n_repeat_words"] / q["n_words"]),
    }


def bin_of(value: Column) -> Column:
    """Sketch bin of a whole number of 0 or more; 0 has its own bin."""
    return F.when(value <= 0, F.lit(-1)).otherwise(
        F.round(F.log(value.cast("double")) / F.log(F.lit(GAMMA)))).cast("int")


def bin_value(b: Column) -> Column:
    return F.when(b < 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b.cast("double")))


def sketches(scored: DataFrame, q: str, lang: str, source: str) -> DataFrame:
    """Bin counts per language, source and ratio: (lang, source, ratio, bin, n)."""
    ratios = _ratios(F.col(q))
    long = scored.filter(~F.col(q)["base_failed"]).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(v).alias("bin")) for r, v in ratios.items()])).alias("e"))
    return long.groupBy("lang", "source", "e.ratio", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Add up sketches to coarser keys."""
    return sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows and a struct of (low, high) for each ratio."""
    part = ", ".join([*keys, "ratio"])
    ranked = sketch.selectExpr(
        *keys, "ratio", "bin",
        f"sum(n) OVER (PARTITION BY {part} ORDER BY bin) AS upto",
        f"sum(n) OVER (PARTITION BY {part}) AS total")
    value = bin_value(F.col("bin"))
    quartiles = ranked.groupBy(*keys, "ratio").agg(
        F.first("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), value)).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, value)).alias("q3"))
    least = F.create_map(*[F.lit(x) for r, v in MIN_SPREAD.items() for x in (r, float(v))])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(least, F.col("ratio")))
    bounds = quartiles.select(*keys, "ratio", "total", (F.col("q1") - FENCE * spread).alias("low"),
                              (F.col("q3") + FENCE * spread).alias("high"))
    return bounds.groupBy(*keys).agg(F.max("total").alias("rows"), *[
        F.max(F.when(F.col("ratio") == r, F.struct("low", "high"))).alias(r) for r in RATIOS])


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Fences of every (lang, source), taken from the finest sketch of the
    source, its language or all documents that holds min_rows."""
    own = fences(sketch, ["lang", "source"])
    by_lang = fences(merge(sketch, ["lang"]), ["lang"])
    overall = fences(merge(sketch, []).withColumn("every", F.lit(0)), ["every"])
    joined = (own.alias("o")
              .join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left")
              .join(overall.alias("a"), F.col("a.every") + F.coalesce(F.col("o.rows") * 0, F.lit(0)) == F.col("o.rows") * 0, "left"))
    pick = [F.when(F.col("o.rows") >= min_rows, F.col(f"o.{r}")).when(F.col("l.rows") >= min_rows, F.col(f"l.{r}"))
            .otherwise(F.col(f"a.{r}")).alias(r) for r in RATIOS]
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *pick)


def score(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Add one struct column with the statistics and base_failed."""
    (q,) = fresh(docs, "stats")
    out = docs.withColumn(q, _stats(F.col(text)))
    return out.withColumn(into, F.struct(*[F.col(q)[s].alias(s) for s in STATS], F.coalesce(
        base_failed(F.col(q)["n_words"], F.col(q)["n_repeat_words"]), F.lit(True)).alias("base_failed"))).drop(q)


def judge(scored: DataFrame, into: str = "quality", lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the fences and add `kept` to a scored, materialised frame."""
    kept, low_high = fresh(scored, "kept", "fence")
    limits = thresholds(sketches(scored, into, lang, source))
    limits = limits.select(F.col("lang").alias(low_high + "_lang"), F.col("source").alias(low_high + "_source"),
                           F.struct(*RATIOS).alias(low_high))
    joined = scored.join(limits, F.col(lang).eqNullSafe(F.col(low_high + "_lang"))
                         & F.col(source).eqNullSafe(F.col(low_high + "_source")), "left")
    inside = F.lit(True)
    for r, v in _ratios(F.col(into)).items():
        inside = inside & v.between(F.col(low_high)[r]["low"], F.col(low_high)[r]["high"])
    verdict = F.when(F.col(into)["base_failed"], F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))
    return joined.withColumn(kept, verdict).drop(low_high, low_high + "_lang", low_high + "_source")


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Statistics and verdict of every row: the struct `quality` and `kept`
    are added. Scored rows are written once and read for both the sketches and
    the verdict."""
    (into,) = fresh(docs, "quality")
    return judge(materialize(score(docs, text, into), "quality"), into, lang, source)
