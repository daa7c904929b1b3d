"""Merkle manifest of a table: a digest per row, a tree per group, a root over
the groups, and for every row the siblings that lead from it to the root.

H is the lowercase hex SHA-256 of its inputs joined; digests enter as hex text.
Every three consecutive nodes of a level (the last run may be shorter) become
their H until one node is left. A group's rows are cut into aligned blocks of
WIDTH = 3^HEIGHT positions, and a block keeps each of its levels as one string
of 64 hex digits per node: fixed-width substrings of 192 digits hash to the
parents, and the digits that flank a node inside its run are its siblings. The
blocks' top digests are the next round's nodes, in blocks again, until every
group has one block; the groups' subroots are a tree of the same kind.

Positions come from a range sort over (group, key, digest, row number): every
range counts its rows per group and running offsets are added, so a group, a
key or a set of equal rows that holds most of the table is spread over many
tasks, and no task sees more than one range or one block.

Defined results: rows ascend by key (nulls first), rows with the same key by
their digest, equal rows stand side by side; a null column enters as `-`; a
null group is a group of its own and comes first; an empty table gives no
rows. Columns that are not named in `columns` are neither hashed nor read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolva.llm.common import DOCUMENTS, let, materialize

ARITY, HEIGHT = 3, 5
WIDTH = ARITY ** HEIGHT
HEX = 64
RECORD = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before:string,after:string>>"
assert set(RECORD) == set(DOCUMENTS)


def record_digest(values: Sequence[Column]) -> Column:
    """H of a record: per value `-` if null, else its UTF-8 length, `:` and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, columns: Sequence[str] = RECORD, key: str = "doc_id", group: str = "source",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: key, leaf, subroot, root, path (siblings before
    and after the node, level by level up to the root) and the `carry` columns."""
    extra = carry or {}
    rows = docs.select(docs[group].alias("g"), docs[key].alias("k"), record_digest([docs[c] for c in columns]).alias("leaf"),
                       F.struct(F.lit(None).cast("boolean").alias("none"), *[c.alias(n) for n, c in extra.items()]).alias("kept"))
    rounds = _climb(rows)
    tops = _union([b.filter(F.col("n") <= WIDTH).select("g", "top") for b in rounds])
    groups = _climb(tops.select(F.lit(0).alias("g"), F.col("g").alias("k"), F.col("top").alias("leaf"),
                                F.struct(F.lit(None).cast("boolean").alias("none")).alias("kept")))
    whole = groups[-1].select("g", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    above = _descend(groups, whole).select(F.col("k").alias("g"), "root", "path")
    out = _descend(rounds, above)
    return out.select(F.col("k").alias(key), "leaf", F.col("top").alias("subroot"), "root", "path",
                      *[F.col("kept")[n].alias(n) for n in extra])


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and a path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _positions(rows: DataFrame) -> DataFrame:
    """Add a node's position in its group and the group's size."""
    rows = materialize(rows.withColumn("u", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["g", "k", "leaf", "u"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("g", "k", "leaf", "kept", F.spark_partition_id().alias("range"),
                                     F.monotonically_increasing_id().alias("at")), "merkle-sorted")
    runs = dealt.groupBy("g", "range").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("g").alias("run_g"), F.col("range").alias("run_range"),
                       (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
                       F.sum("rows").over(whole).alias("n"))
    near = F.col("g").eqNullSafe(F.col("run_g")) & (F.col("range") == F.col("run_range"))
    return dealt.join(runs, near).select("g", (F.col("at") + F.col("shift")).alias("pos"), "n",
                                         F.struct("k", "leaf", "kept").alias("node"))


def _parents(level: Column) -> Column:
    """The level above: H of every run of three digests."""
    width = HEX * ARITY
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _levels(members: Column, n: Column) -> Column:
    """A block's levels from its nodes to its top digest. A block that is its
    whole group stops at one node; any other block rises HEIGHT levels, so that
    its top stands on the same level as its neighbours'."""
    lowest = F.array_join(F.transform(members, lambda m: m["node"]["leaf"]), "").cast("binary")

    def rise(levels: Column, _: Column) -> Column:
        return let(F.element_at(levels, -1), lambda last: F.when((n > WIDTH) | (F.length(last) > HEX), F.concat(
            levels, F.array(_parents(last)))).otherwise(levels))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(lowest), rise)


def _siblings(levels: Column, at: Column) -> Column:
    """The digits before and after a node in its run, on each level below the top."""
    def beside(level: Column, height: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(ARITY), height)).cast("int")
        place = node % ARITY
        before = level.substr((node - place) * HEX + 1, place * HEX)
        after = level.substr(node * HEX + HEX + 1, (ARITY - 1 - place) * HEX)
        return F.struct(before.cast("string").alias("before"), after.cast("string").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _climb(rows: DataFrame) -> list[DataFrame]:
    """Block tables (g, b, n, members, top) from the leaves up. Each round has
    one row for WIDTH nodes of the round below."""
    nodes, rounds = _positions(rows), []
    while True:
        gathered = nodes.groupBy("g", F.floor(F.col("pos") / WIDTH).alias("b")).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("members"))
        blocks = materialize(gathered.withColumn("top", F.element_at(_levels(F.col("members"), F.col("n")), -1).cast("string")),
                             "merkle-blocks")
        rounds.append(blocks)
        wide = blocks.filter(F.col("n") > WIDTH)
        if wide.isEmpty():
            return rounds
        nodes = wide.select("g", F.col("b").alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"),
                            F.struct(F.col("b").alias("k"), F.col("top").alias("leaf"), F.lit(None).cast("boolean").alias("kept")).alias("node"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Hand root, subroot and paths down to the leaves: a block's path goes to
    its members behind their own siblings. `above`: g, root, path per group."""
    known = None
    for blocks in reversed(rounds):
        ends = blocks.filter(F.col("n") <= WIDTH).select(F.col("g").alias("up_g"), F.col("b").alias("up_b"), F.col("top").alias("up_top"))
        roots = above.select(F.col("g").alias("root_g"), F.col("root").alias("up_root"), F.col("path").alias("up_path"))
        ends = ends.join(roots, F.col("up_g").eqNullSafe(F.col("root_g"))).drop("root_g")
        up = ends if known is None else ends.unionByName(known.select(
            F.col("g").alias("up_g"), F.col("k").alias("up_b"), F.col("top").alias("up_top"), F.col("root").alias("up_root"),
            F.col("path").alias("up_path")))
        met = blocks.drop("top").join(up, F.col("g").eqNullSafe(F.col("up_g")) & (F.col("b") == F.col("up_b")))
        placed = let(_levels(F.col("members"), F.col("n")), lambda levels: F.transform(F.col("members"), lambda m, i: F.struct(
            m["node"].alias("node"), F.concat(_siblings(levels, i), F.col("up_path")).alias("path"))))
        known = met.select("g", "up_top", "up_root", F.explode(placed).alias("x")).select(
            "g", "x.node.*", F.col("x.path").alias("path"), F.col("up_top").alias("top"), F.col("up_root").alias("root"))
    return known
