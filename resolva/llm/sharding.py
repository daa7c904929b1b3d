"""Sharding by a hierarchical weighted hash tree.

A tree is region → rack → shard, each node with a weight; an inner node weighs
as much as its shards together. A key descends the tree: at every level each
child draws `-ln(u) / weight` with `u` hashed from (child name, key), and the
least draw wins. A child's draw depends on its own name and weight only, so
when a weight grows, keys move only into the subtree that grew, and a key whose
path avoids the changed nodes stays where it is.

Defined results: a null key is the key `null`; repeated keys go to the same
shard; a node of weight 0 gets nothing; an empty table gives no rows. Extra
columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh, with_row_id

#: Hash groups that a shard's slots are numbered in; a task sorts one of them.
SLOT_GROUPS = 1024


@dataclass(frozen=True)
class Node:
    """A tree node; leaves carry a shard number and a weight."""
    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree_of(regions: dict[str, dict[str, dict[int, float]]]) -> Node:
    """Build a tree from {region: {rack: {shard: weight}}}."""
    return Node("root", children=tuple(
        Node(region, children=tuple(
            Node(f"{region}/{rack}", children=tuple(
                Node(f"{region}/{rack}/{shard}", float(weight), shard)
                for shard, weight in shards.items()))
            for rack, shards in racks.items()))
        for region, racks in regions.items()))


def even_tree(n_regions: int = 2, n_racks: int = 2, n_shards: int = 2) -> Node:
    """Shards 0..n-1 of weight 1, dealt to regions and racks in order."""
    spec, shard = {}, 0
    for r in range(n_regions):
        racks = {}
        for k in range(n_racks):
            racks[f"k{k}"] = {shard + i: 1.0 for i in range(n_shards)}
            shard += n_shards
        spec[f"r{r}"] = racks
    return tree_of(spec)


def with_region(tree: Node, name: str, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: every other
    subtree keeps its weight, so keys move only into the new shard."""
    leaf = Node(f"{name}/k0/{shard}", float(weight), shard)
    return Node(tree.name, children=(*tree.children, Node(name, children=(Node(f"{name}/k0", children=(leaf,)),))))


def _uniform(name: str, key: Column) -> Column:
    """52 hashed bits as a double in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(name + ":"), key)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def descend(node: Node, key: Column) -> Column:
    """The shard that a string key reaches below a node."""
    if not node.children:
        return F.lit(node.shard).cast("int")
    live = [c for c in node.children if c.total > 0]
    if len(live) == 1:
        return descend(live[0], key)
    draws = F.array(*[F.struct((-F.log(_uniform(c.name, key)) / F.lit(c.total)).alias("draw"), F.lit(i).alias("child"))
                      for i, c in enumerate(live)])
    pick = F.array_min(draws)["child"]
    out = F.when(pick == 0, descend(live[0], key))
    for i, c in enumerate(live[1:], 1):
        out = out.when(pick == i, descend(c, key))
    return out


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def shard_rows(df: DataFrame, key: str, tree: Node, grown: Node | None = None, shard_col: str = "shard",
               grown_col: str = "grown_shard") -> DataFrame:
    """Add the shard of every row, and its shard in a grown tree, as the last
    columns, under other names where the frame has these."""
    k, shard_col, grown_col = fresh(df, "shard_key", shard_col, grown_col)
    df = df.withColumn(k, key_text(F.col(key)))
    df = df.withColumn(shard_col, descend(tree, F.col(k)))
    if grown is not None:
        df = df.withColumn(grown_col, descend(grown, F.col(k)))
    return df.drop(k)


def with_slots(df: DataFrame, key: str, order: list[str], shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    The rows are written once with a row id. A shard's rows fall into
    SLOT_GROUPS groups by a hash of key and row id, so neither a large shard nor
    a key that many rows share meets in one task. Group sizes are counted first
    (one row per shard and group), their running sums are the groups' first
    slots, and rows are numbered inside a group.
    """
    rid, g, n, first, at, slot_col = fresh(df, "slot_row", "slot_group", "group_rows", "group_first", "group_at", slot_col)
    columns, df = df.columns, with_row_id(df, rid, "shard-slots")
    grouped = df.withColumn(g, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("slot"), key_text(F.col(key)), F.col(rid).cast("string"))), 1, 8), 16, 10)
                            .cast("long") % SLOT_GROUPS)
    sizes = grouped.groupBy(shard_col, g).agg(F.count(F.lit(1)).alias(n))
    firsts = sizes.selectExpr(
        f"`{shard_col}`", f"`{g}`",
        f"sum(`{n}`) OVER (PARTITION BY `{shard_col}` ORDER BY `{g}`) - `{n}` AS `{first}`")
    by = ", ".join(f"`{c}`" for c in [key, *order, rid])
    numbered = grouped.selectExpr("*", f"row_number() OVER (PARTITION BY `{shard_col}`, `{g}` ORDER BY {by}) AS `{at}`")
    # at most shards x SLOT_GROUPS rows
    joined = numbered.join(F.broadcast(firsts), [shard_col, g])
    return joined.select(*columns, (F.col(first) + F.col(at) - 1).alias(slot_col))
