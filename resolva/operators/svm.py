"""Linear SVM with squared hinge loss and a penalised intercept.

Minimises ½‖(w, b)‖² + C Σ cᵢ max(0, 1 − yᵢ(w·xᵢ + b))² with balanced class
weights cᵢ by limited-memory BFGS. A step needs one pass over the packed rows
(`packed.py`), in which every task adds up loss and gradient of its rows; the
driver holds a few gradients of the encoded width, whatever the row count. The
probability is the mean of k Platt sigmoids, each fitted on the
stratified fold that its member has not seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET
from .encode import Encoder
from .folds import stratified_folds
from .packed import Block, packed, summed

MEMORY = 10


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, tol: float,
             max_iter: int) -> tuple[np.ndarray, float]:
    """Limited-memory BFGS with a backtracking line search. Ends when the
    gradient's norm is at most `tol` of the first one; gives the point and that share."""
    x = np.zeros(size)
    f, g = value_and_gradient(x)
    first = np.linalg.norm(g) or 1.0
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.linalg.norm(g) <= tol * first:
            break
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (y @ s)
            kept.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            d += s * (a - y @ d / (y @ s))
        step = 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(g))
        for _ in range(40):
            there = x - step * d
            f_new, g_new = value_and_gradient(there)
            if f_new <= f - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break                      # no step goes down any more: the numbers' precision is reached
        if (there - x) @ (g_new - g) > 0:
            steps = [*steps, (there - x, g_new - g)][-MEMORY:]
        x, f, g = there, f_new, g_new
    return x, float(np.linalg.norm(g) / first)


def fit_squared_hinge(rows: DataFrame, width: int, C: float, tol: float = 1e-6, max_iter: int = 3000) -> tuple[np.ndarray, float, float]:
    """(w, b, gradient's share of the first) on rows with case_id, cells and target."""
    blocks = packed(rows)
    n, positive = summed(blocks, 2, lambda block, total: np.add(total, [len(block.y), block.y.sum()], out=total))
    weight = [n / (2.0 * c) if c else 0.0 for c in (n - positive, positive)]

    def value_and_gradient(point: np.ndarray) -> tuple[float, np.ndarray]:
        w = np.append(point[:width], 0.0)         # the last number stands for unseen values
        b = point[width]

        def add(block: Block, total: np.ndarray) -> None:
            y = np.where(block.y == 1, 1.0, -1.0)
            c = np.where(y > 0, weight[1], weight[0])
            gap = np.maximum(0.0, 1.0 - y * (w[block.cells].sum(1) + b))
            slope = -2.0 * C * c * y * gap
            total[0] += C * float((c * gap * gap).sum())
            total[1] += float(slope.sum())
            total[2:] += np.bincount(block.cells.ravel(), np.repeat(slope, block.cells.shape[1]), width + 1)

        total = summed(blocks, width + 3, add)
        gradient = np.append(total[2:2 + width], total[1]) + point
        return total[0] + 0.5 * float(point @ point), gradient

    try:
        point, share = minimise(value_and_gradient, width + 1, tol, max_iter)
    finally:
        blocks.unpersist()
    return point[:width], float(point[width]), share


def margin(encoder: Encoder, w: np.ndarray, b: float) -> Column:
    """w·x + b of a row with cells, from array lookups."""
    weights = F.array(*[F.lit(float(x)) for x in [*w, 0.0]])
    return F.aggregate("cells", F.lit(float(b)), lambda total, c: total + F.element_at(weights, c + 1))


def platt(margins: DataFrame) -> tuple[float, float]:
    """Sigmoid fit on held-out margins with smoothed targets
    t+ = (N+ + 1)/(N+ + 2), t- = 1/(N- + 2): each row enters twice
    (label 1 with weight t, label 0 with weight 1 - t)."""
    counts = {r[TARGET]: r["c"] for r in margins.groupBy(TARGET).agg(F.count(F.lit(1)).alias("c")).collect()}
    npos, nneg = counts.get(1, 0), counts.get(0, 0)
    tpos, tneg = (npos + 1.0) / (npos + 2.0), 1.0 / (nneg + 2.0)
    t = F.when(F.col(TARGET) == 1, F.lit(tpos)).otherwise(F.lit(tneg))
    two = (margins.select("margin", F.lit(1.0).alias("label"), t.alias("w"))
                  .unionByName(margins.select("margin", F.lit(0.0).alias("label"), (1.0 - t).alias("w"))))
    va = VectorAssembler(inputCols=["margin"], outputCol="mf")
    lr = LogisticRegression(featuresCol="mf", labelCol="label", weightCol="w", regParam=0.0,
                            standardization=False, maxIter=100, tol=1e-6)
    m = lr.fit(va.transform(two))
    return float(m.coefficients[0]), float(m.intercept)


@dataclass
class Member:
    """One linear machine and its sigmoid."""
    w: np.ndarray
    b: float
    slope: float
    shift: float
    gradient_share: float = 0.0


@dataclass
class CalibratedSVM:
    members: list[Member]

    def to_json(self) -> str:
        return json.dumps([vars(m) | {"w": m.w.tolist()} for m in self.members])

    @staticmethod
    def from_json(text: str) -> CalibratedSVM:
        return CalibratedSVM([Member(**m | {"w": np.array(m["w"])}) for m in json.loads(text)])

    def probability(self, encoder: Encoder) -> Column:
        """Mean of the members' probabilities for a row with cells."""
        each = [1.0 / (1.0 + F.exp(-(F.lit(m.slope) * margin(encoder, m.w, m.b) + F.lit(m.shift)))) for m in self.members]
        return sum(each[1:], each[0]) / float(len(each))


def fit_calibrated(rows: DataFrame, encoder: Encoder, C: float = 0.1, k: int = 3, seed: int = 42, tol: float = 1e-6,
                   max_iter: int = 3000, parallelism: int = 3) -> CalibratedSVM:
    """k members on encoded rows (case_id, target, cells). Folds are
    independent, so they are fitted as concurrent Spark jobs."""
    folded = stratified_folds(rows.select("case_id", TARGET, "cells"), TARGET, k, "case_id", seed).persist()

    def member(i: int) -> Member:
        w, b, share = fit_squared_hinge(folded.filter(F.col("_fold") != i), encoder.width, C, tol, max_iter)
        held = folded.filter(F.col("_fold") == i).select(TARGET, margin(encoder, w, b).alias("margin"))
        return Member(w, b, *platt(held), share)

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            return CalibratedSVM(list(pool.map(member, range(k))))
    finally:
        folded.unpersist()
