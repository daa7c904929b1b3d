"""Distributed evaluation of a scored table `(y, p)` from one table of counts.

`score_counts` is the only pass over scored rows: positives and negatives per
(group, score), with map-side partial sums, so a score that a third of all
rows share is one row. Counts of parts add up to the counts of the whole.
Everything else reads that table alone:

* `sweep`: confusion cells and macro-F1 at all 81 thresholds. A score becomes
  k = #{grid thresholds <= p}; the (group, k) histogram has at most 82 rows a
  group, and sums over it give every threshold.
* `cells_at`: the same cells at thresholds of the caller's.
* `losses`: log loss and Brier score.
* `ladder`: counts strictly below each score, exact and without a global
  single-partition sort: scores are cut into range buckets by approximate
  quantile boundaries; the bucket totals (at most `buckets` rows a group) give
  offsets, and a window partitioned by bucket gives the running sums inside.
* `auc` (Mann-Whitney with half credit for ties) and the quantile `calibration`
  read the ladder.

`metrics_at`, `threshold_sweep`, `roc_auc` and `calibration_curve` take scored
rows, count them and call these.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Threshold grid 0.10 … 0.90 with the step spacing of a float
# `arange(0.10, 0.91, 0.01)` (value i is 0.10 + i * ((0.10 + 0.01) - 0.10)).
GRID_START, GRID_STEP, GRID_SIZE = 0.10, 0.01, 81
THRESHOLDS = [GRID_START + i * ((GRID_START + GRID_STEP) - GRID_START) for i in range(GRID_SIZE)]
CLIP_EPS = 1e-15
CALIBRATION_BINS = 10


def clip_proba(p):
    return F.least(F.greatest(p, F.lit(CLIP_EPS)), F.lit(1 - CLIP_EPS))


def _safe_div(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _with_rates(df: DataFrame) -> DataFrame:
    """Add accuracy / precision / recall / F1 (class 1 and macro) from tn fp fn tp."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    return df.select(
        "*",
        _safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        p1.alias("precision_resolvida"), r1.alias("recall_resolvida"), f1.alias("f1_resolvida"),
        ((p0 + p1) / 2).alias("precision_macro"), ((r0 + r1) / 2).alias("recall_macro"),
        ((f0 + f1) / 2).alias("f1_macro"))


def score_counts(scored: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p", clip: bool = False) -> DataFrame:
    """by…, p, pos, neg: how many rows of each class have the score (p double,
    -0.0 as 0.0). With `clip`, scores are first put into [1e-15, 1 - 1e-15]."""
    by = by or []
    value = F.col(p).cast("double") + F.lit(0.0)
    return (scored.select(*by, (clip_proba(value) if clip else value).alias("p"), F.col(y).cast("int").alias("y"))
                  .groupBy(*by, "p")
                  .agg(F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))


def add_counts(parts: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Counts of several parts (days, shards) as the counts of their union."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*(by or []), "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def losses(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by…, n, log_loss, brier_score, over clipped scores."""
    pc, pos, neg = clip_proba(F.col("p")), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    return counts.groupBy(*(by or [])).agg(
        n.alias("n"), (-F.sum(pos * F.log(pc) + neg * F.log(1 - pc)) / n).alias("log_loss"),
        (F.sum(pos * (1 - pc) * (1 - pc) + neg * pc * pc) / n).alias("brier_score"))


def cells_at(counts: DataFrame, threshold, by: list[str] | None = None) -> DataFrame:
    """by…, threshold, tn, fp, fn, tp and rates at a number or a column of thresholds."""
    by = by or []
    fixed = isinstance(threshold, (int, float))
    pred = clip_proba(F.col("p")) >= (F.lit(float(threshold)) if fixed else F.col(threshold))
    cells = counts.groupBy(*by, *([] if fixed else [threshold])).agg(
        F.sum(F.when(~pred, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(pred, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(pred, F.col("pos")).otherwise(0)).alias("tp"))
    return _with_rates(cells.withColumn("threshold", F.lit(float(threshold))) if fixed else cells)


def metrics_at(scored: DataFrame, threshold, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Threshold metrics, log loss and Brier score (optionally per group) at a
    number or at a column of thresholds that is constant in each group."""
    by = by or []
    keys = by + ([] if isinstance(threshold, (int, float)) else [threshold])
    counts = score_counts(scored, keys, y, p)
    cells, loss = cells_at(counts, threshold, by), losses(counts, keys)
    return cells.join(loss, keys) if keys else cells.crossJoin(loss)      # one row each without groups


def threshold_sweep(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    return sweep(score_counts(scored, by, y, p), by)


def sweep(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro-F1 (and the confusion cells) at each of the 81 grid thresholds.

    Each row of the (group, k) histogram is spread over the 81 thresholds that
    it does or does not reach: at most 82·81 tiny rows a group.
    Output: by…, i, threshold, tn, fp, fn, tp, accuracy, … f1_macro.
    """
    by = by or []
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    k = F.size(F.filter(grid, lambda t: F.col("p") >= t)).alias("k")
    hist = counts.groupBy(*by, k).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spread = hist.select(*by, "k", "pos", "neg",
                         F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))).alias("i"))
    reached = F.col("k") > F.col("i")          # p >= t_i  ⇔  k > i
    cells = (spread.groupBy(*by, "i")
                   .agg(F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
                        F.sum(F.when(reached, F.col("neg")).otherwise(0)).alias("fp"),
                        F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    rows = cells.select(*by, "i", F.element_at(grid, F.col("i") + 1).alias("threshold"),
                        (F.col("N") - F.col("fp")).alias("tn"), "fp",
                        (F.col("P") - F.col("tp")).alias("fn"), "tp")
    return _with_rates(rows)


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Highest macro-F1 per group; ties go to the smallest threshold."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.desc("f1_macro"), F.asc("i"))
    return (sweep.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                 .select(*by, "threshold", F.col("f1_macro").alias("best_f1_macro")))


def _n_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    sp = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, 2 * sp)


def score_ladder(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None,
                 buckets: int | None = None) -> DataFrame:
    return ladder(score_counts(scored, by, y, p).checkpoint(eager=True), by, buckets)


def ladder(counts: DataFrame, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Counts at and strictly below each score: by…, p, pos, neg, pos_below,
    neg_below. `counts` is read three times: pass a written or checkpointed table."""
    by = by or []
    b = _n_buckets(counts, buckets)
    probs = [i / b for i in range(1, b)]
    row = counts.agg(F.percentile_approx("p", probs, max(10000, 10 * b)).alias("q")).first()
    bounds = sorted(set(x for x in (row["q"] or []) if x is not None and not math.isnan(x)))
    if bounds:
        splits = [-math.inf] + bounds + [math.inf]
        bucketed = Bucketizer(splits=splits, inputCol="p", outputCol="bucket",
                              handleInvalid="keep").transform(counts)
    else:
        bucketed = counts.withColumn("bucket", F.lit(0.0))
    totals = bucketed.groupBy(*by, "bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # ≤ groups × len(splits) rows: bounded by the bucket count we chose.
    offsets = totals.select(*by, "bucket",
                            F.coalesce(F.sum("bpos").over(before), F.lit(0)).alias("pos_off"),
                            F.coalesce(F.sum("bneg").over(before), F.lit(0)).alias("neg_off"))
    inb = Window.partitionBy(*by, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return (bucketed.join(offsets, by + ["bucket"])
                    .select(*by, "p", "pos", "neg",
                            (F.col("pos_off") + F.coalesce(F.sum("pos").over(inb), F.lit(0))).alias("pos_below"),
                            (F.col("neg_off") + F.coalesce(F.sum("neg").over(inb), F.lit(0))).alias("neg_below")))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None,
            buckets: int | None = None) -> DataFrame:
    return auc(score_counts(scored, by, y, p).checkpoint(eager=True), by, buckets)


def auc(counts: DataFrame, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC: Σ pos·(neg_below + neg/2) / (P·N); NULL when a class is absent."""
    by = by or []
    agg = ladder(counts, by, buckets).groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("s"),
        F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"))
    return agg.select(*by, F.when((F.col("P") * F.col("N")) > 0, F.col("s") / (F.col("P") * F.col("N")))
                            .alias("roc_auc"))


def exact_quantiles(ladder: DataFrame, qs: list[tuple[int, int]]) -> list[float]:
    """Linear-interpolated quantiles from a ladder; q given as exact fractions (num, den).

    Only the ≤ 2·len(qs) ladder rows holding the needed order statistics
    are collected.
    """
    tot = ladder.agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).first()["n"] or 0
    if tot == 0:
        return []
    targets = {}
    for num, den in qs:
        h_num = (tot - 1) * num
        lo = h_num // den
        frac = (h_num % den) / den
        targets[(num, den)] = (lo, min(lo + 1, tot - 1), frac)
    ranks = sorted({r for lo, hi, _ in targets.values() for r in (lo, hi)})
    below = F.col("pos_below") + F.col("neg_below")
    cnt = F.col("pos") + F.col("neg")
    cond = F.lit(False)
    for r in ranks:
        cond = cond | ((below <= r) & (below + cnt > r))
    rows = ladder.filter(cond).select("p", below.alias("b"), cnt.alias("c")).collect()

    def value_at(r):
        for row in rows:
            if row["b"] <= r < row["b"] + row["c"]:
                return row["p"]
        raise RuntimeError("rank not found")

    out = []
    for num, den in qs:
        lo, hi, frac = targets[(num, den)]
        a, bb = value_at(lo), value_at(hi)
        out.append(a + (bb - a) * frac)
    return out


def calibration_curve(scored: DataFrame, y: str = "y", p: str = "p",
                      n_bins: int = CALIBRATION_BINS, buckets: int | None = None) -> DataFrame:
    return calibration(score_counts(scored, None, y, p).checkpoint(eager=True), n_bins, buckets)


def calibration(counts: DataFrame, n_bins: int = CALIBRATION_BINS, buckets: int | None = None) -> DataFrame:
    """Reliability table over quantile bins: (bin, n, prob_pred, prob_true).

    Bin edges are exact linear quantiles; a score equal to an inner edge goes
    to the lower bin; empty bins do not appear.
    """
    edges = exact_quantiles(ladder(counts, None, buckets), [(i, n_bins) for i in range(1, n_bins)])
    inner = F.array(*[F.lit(float(e)) for e in edges])
    bin_ = F.size(F.filter(inner, lambda e: e < F.col("p"))) if edges else F.lit(0)
    both = F.col("pos") + F.col("neg")
    return (counts.groupBy(bin_.alias("bin"))
                  .agg(F.sum(both).alias("n"), (F.sum(F.col("p") * both) / F.sum(both)).alias("prob_pred"),
                       (F.sum("pos") / F.sum(both)).alias("prob_true")))
