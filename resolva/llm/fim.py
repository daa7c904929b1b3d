"""Fill-in-the-middle transformation.

A text's units are words with the white space before them; white space at the
end is a unit of its own. Its UTF-8 bytes are cut into blocks of BLOCK bytes,
and two Fenwick trees over the blocks hold their unit and code-point counts. A
cut after k units descends the unit tree by binary lifting to the block that
holds the k-th unit end, finds the end among the block's own bytes, and reads
the code points before it off the second tree. Only the cuts leave the Arrow
function; the pieces are put together by SQL functions.

The draws come from the SHA-256 of `seed:key`, so a row's form and cuts do not
depend on the other rows or on partitions.

Defined results: a null text is the empty text; an empty text and a text that
holds a sentinel stay plain; a null key draws from the hash of `seed:`;
repeated keys draw the same numbers, each for its own text. Rows with other
columns of any name may come in; only key and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLOCK = 4096
SENTINELS = ("<P>", "<S>", "<M>")


class BlockCounts:
    """Fenwick tree over the counts of marked bytes per block."""

    def __init__(self, marks: np.ndarray, block: int):
        self.marks, self.block = marks, block
        starts = np.arange(0, len(marks), block)
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(marks, starts, dtype=np.int64) if len(marks) else [])]).astype(np.int64)
        at = np.arange(len(sums))
        self.tree = sums - sums[at - (at & -at)]   # node i covers the blocks (i - lowbit(i), i]
        self.total = int(sums[-1])

    def before(self, blocks: int) -> int:
        """Marks in the first `blocks` blocks."""
        total = 0
        while blocks:
            total += int(self.tree[blocks])
            blocks &= blocks - 1
        return total

    def find(self, k: int) -> int:
        """Byte position behind the k-th mark (k from 1)."""
        at, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < k:
                at += step
                k -= int(self.tree[at])
            step >>= 1
        first = at * self.block
        return first + int(np.flatnonzero(self.marks[first:first + self.block])[k - 1]) + 1


def cut_points(data: np.ndarray, draws: Sequence[int], block: int = BLOCK) -> tuple[int, int, int]:
    """Number of units, and code points before the lower and the upper cut."""
    if not len(data):
        return 0, 0, 0
    space = (data == 32) | ((data >= 9) & (data <= 13))
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = True                     # a word's last byte, or white space that ends the text
    units = BlockCounts(ends, block)
    points = BlockCounts((data & 0xC0) != 0x80, block)
    places = []
    for k in sorted(d % (units.total + 1) for d in draws):
        byte = units.find(k) if k else 0
        whole = byte // block
        places.append(points.before(whole) + int(np.count_nonzero(points.marks[whole * block:byte])))
    return units.total, *places


CUTS = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "low", "high")]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    for t, a, b in zip(text, first.to_pylist(), second.to_pylist()):
        n, low, high = cut_points(np.frombuffer(t.as_buffer(), np.uint8), (a, b))
        rows.append({"n": n, "low": low, "high": high})
    return pa.array(rows, CUTS)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50,
              spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: key, n, form (plain, psm, spm), prefix_chars,
    middle_chars and output."""
    p, s, m = (F.lit(x) for x in sentinels)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"), hashed.alias("hex"))
    rows = rows.select("k", "t", *[F.conv(F.substring("hex", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    rows = rows.withColumn("cut", _cuts("t", "h1", "h2"))
    taken = F.contains("t", p) | F.contains("t", s) | F.contains("t", m)
    form = F.when((F.col("t") == "") | taken | (F.col("h3") % 100 >= percent), "plain").when(
        F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    rows = rows.select("k", "t", "cut", form.alias("form"), F.col("t").substr(F.lit(1), low).alias("prefix"),
                       F.col("t").substr(low + 1, high - low).alias("middle"),
                       F.col("t").substr(high + 1, F.length("t")).alias("suffix"))
    output = (F.when(F.col("form") == "plain", F.col("t"))
              .when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
              .otherwise(F.concat(s, "suffix", p, "prefix", m, "middle")))
    cut = F.col("form") != "plain"
    return rows.select(F.col("k").alias(key), F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.low")).alias("prefix_chars"),
                       F.when(cut, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    def pieces(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        """What follows each of three sentinels, found in this order."""
        def after(mark: str, value: Column) -> Column:
            return value.substr(F.locate(mark, value) + len(mark), F.length(value))

        def until(mark: str, value: Column) -> Column:
            return value.substr(F.lit(1), F.locate(mark, value) - 1)

        rest = output.substr(F.lit(len(first) + 1), F.length(output))
        return until(second, rest), until(third, after(second, rest)), after(third, after(second, rest))

    p, s, m = sentinels
    prefix, suffix, middle = pieces(p, s, m)
    suffix2, prefix2, middle2 = pieces(s, p, m)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(
        F.concat(prefix2, middle2, suffix2))
