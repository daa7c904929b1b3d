"""Second-order gradient boosting over one-hot columns, by histograms.

Each level of a tree is one pass over the packed rows (`packed.py`): a task finds
the node of its rows in numpy and adds up, per (node, column), the log loss's
gradients and hessians over its rows that have the column. A split sends the
rows with a column one way and all others the other, so those sums and the
node's totals give every split's gain

    ½ (G_l² / (H_l + λ) + G_r² / (H_r + λ) − G² / (H + λ)),

taken if both hessian sums reach the floor. Rows are sampled per tree by a hash
of key and round, columns by a seeded draw. Sums are taken over whole numbers
(2⁻³⁰ steps), so the same rows give the same trees whatever the partitions.

A row has one column per feature, always at that feature's place, so whether it
has a column is one look at that place.

The driver holds one level's histogram: at most 2^depth nodes times the encoded
width. Each tree's margins are added to the blocks once, in the first pass of
the next tree. Every CHECK rounds the blocks are written to the checkpoint
folder, so a lost executor costs a few trees' work.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .packed import Block, cells_of, packed, summed

UNIT = float(1 << 30)
CHECK = 10


@dataclass
class Tree:
    """Nodes in arrays. `cell` is the split column (-1: leaf) and `place` its
    feature's place in a row; rows that have it go to `right`, others to `left`;
    `value` is a leaf's margin."""
    cell: list[int] = field(default_factory=lambda: [-1])
    place: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, cell: int, place: int, gain: float) -> tuple[int, int]:
        self.cell[node], self.place[node], self.gain[node] = cell, place, gain
        self.left[node], self.right[node] = len(self.cell), len(self.cell) + 1
        for _ in range(2):
            for column, empty in ((self.cell, -1), (self.place, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def leaf_of(self, cells: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        cell, place, left, right = (np.array(x) for x in (self.cell, self.place, self.left, self.right))
        at = np.zeros(len(cells), np.int64)
        while True:
            inner = np.flatnonzero(cell[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            has = cells[inner, place[here]] == cell[here]
            at[inner] = np.where(has, right[here], left[here])

    def margins(self, cells: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(cells)]


def margins(trees: list[Tree], cells: np.ndarray) -> np.ndarray:
    total = np.zeros(len(cells))
    for tree in trees:
        total += tree.margins(cells)
    return total


@dataclass
class Booster:
    base: float
    trees: list[Tree]
    width: int

    def margins(self, cells: np.ndarray) -> np.ndarray:
        return self.base + margins(self.trees, cells)

    def gains(self) -> np.ndarray:
        """Mean gain of the splits on each column, as shares of their sum."""
        total, count = np.zeros(self.width), np.zeros(self.width)
        for tree in self.trees:
            for c, g in zip(tree.cell, tree.gain):
                if c >= 0:
                    total[c] += g
                    count[c] += 1
        mean = total / np.maximum(count, 1)
        return mean / (mean.sum() or 1.0)

    def probability(self, spark: SparkSession) -> Column:
        """Positive probability of a row with cells."""
        model = spark.sparkContext.broadcast(self)

        @F.arrow_udf(DoubleType())
        def run(cells: pa.Array) -> pa.Array:
            if not len(cells):
                return pa.array([], pa.float64())
            return pa.array(1.0 / (1.0 + np.exp(-model.value.margins(cells_of(cells)))))

        return run(F.col("cells"))

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "width": self.width, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Booster:
        found = json.loads(text)
        return Booster(found["base"], [Tree(**t) for t in found["trees"]], found["width"])


def _hash01(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) from a 64-bit row key and a round."""
    x = keys.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def best_splits(g: np.ndarray, h: np.ndarray, total_g: np.ndarray, total_h: np.ndarray, allowed: np.ndarray, floor: float,
                penalty: float) -> list[tuple[int, float] | None]:
    """Per node the column with the highest gain (the lowest number of equals)."""
    rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
    whole = (total_g ** 2 / (total_h + penalty))[:, None]
    gain = 0.5 * (g ** 2 / (h + penalty) + rest_g ** 2 / (rest_h + penalty) - whole)
    gain = np.where((h >= floor) & (rest_h >= floor) & allowed[None, :], gain, -np.inf)
    best = gain.argmax(1)
    return [(int(c), float(gain[i, c])) if gain[i, c] > 1e-6 else None for i, c in enumerate(best)]


def fit(rows: DataFrame, width: int, rounds: int = 250, depth: int = 6, rate: float = 0.08, floor: float = 3.0,
        row_share: float = 0.8, column_share: float = 0.8, penalty: float = 1.0, seed: int = 42, key: str = "case_id") -> Booster:
    """Boost on encoded rows (key, target, cells)."""
    blocks = packed(rows, key)
    n, positive, *found = summed(blocks, 2 + 2 * wide_of(width), _count)
    seen, places = np.reshape(found, (2, -1))[:, :width]
    places = (places / np.maximum(seen, 1)).astype(int)      # a column's feature: all its rows have it at one place
    mean = min(max(positive / n, 1e-6), 1 - 1e-6) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    draw = np.random.default_rng(seed)
    trees: list[Tree] = []

    for number in range(1, rounds + 1):
        allowed = np.zeros(width, bool)
        allowed[draw.choice(width, max(1, round(column_share * width)), replace=False)] = True
        tree, open_nodes, before = Tree(), [0], None
        if trees:
            before, blocks = blocks, blocks.map(lambda b, last=trees[-1]: Block(b.key, b.y, b.cells, b.margin + last.margins(b.cells)))
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
            if number % CHECK == 1:
                blocks.checkpoint()
        for _ in range(depth):
            n_nodes, wide = len(open_nodes), wide_of(width)

            def histogram(block: Block, total: np.ndarray, grown=tree, number=number, open_nodes=tuple(open_nodes), wide=wide) -> None:
                row = np.full(len(grown.cell), -1)
                row[list(open_nodes)] = np.arange(len(open_nodes))
                node = row[grown.leaf_of(block.cells)]
                use = np.flatnonzero((node >= 0) & (_hash01(block.key, number) < row_share))
                start, size = node[use] * wide, len(open_nodes) * wide
                p = 1.0 / (1.0 + np.exp(-(base + block.margin[use])))
                flat = (start[:, None] + block.cells[use]).ravel()
                for at, value in enumerate((p - block.y[use], p * (1 - p))):
                    value, half = np.rint(value * UNIT), total[at * size:(at + 1) * size]
                    half += np.bincount(start + width + 1, value, size).astype(np.int64)
                    half += np.bincount(flat, np.repeat(value, block.cells.shape[1]), size).astype(np.int64)

            g, h = summed(blocks, 2 * n_nodes * wide, histogram, "i8").reshape(2, n_nodes, wide) / UNIT
            if before is not None:
                before.unpersist()
                before = None
            total_g, total_h = g[:, width + 1], h[:, width + 1]
            if open_nodes == [0]:
                tree.value[0] = _leaf(total_g[0], total_h[0], rate, penalty)
            splits = best_splits(g[:, :width], h[:, :width], total_g, total_h, allowed, floor, penalty)
            children = []
            for i, (node, split) in enumerate(zip(open_nodes, splits)):
                if split:
                    c, gain = split
                    left, right = tree.split(node, c, int(places[c]), gain)
                    tree.value[left] = _leaf(total_g[i] - g[i, c], total_h[i] - h[i, c], rate, penalty)
                    tree.value[right] = _leaf(g[i, c], h[i, c], rate, penalty)
                    children += [left, right]
            open_nodes = children
            if not open_nodes:
                break
        trees.append(tree)
    blocks.unpersist()
    return Booster(base, trees, width)


def wide_of(width: int) -> int:
    """Numbers of a node's histogram: its columns, unseen values, its totals."""
    return width + 2


def _count(block: Block, total: np.ndarray) -> None:
    """Rows, positive rows, and per column its rows and the sum of its places."""
    seen, places = total[2:].reshape(2, -1)
    total[:2] += len(block.y), block.y.sum()
    for place, column in enumerate(block.cells.T):
        here = np.bincount(column, minlength=len(seen))
        seen += here
        places += here * place


def _leaf(g: float, h: float, rate: float, penalty: float) -> float:
    return float(-rate * g / (h + penalty))
