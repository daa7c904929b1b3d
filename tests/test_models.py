import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from resolva.operators import boosting, svm
from resolva.operators import evaluate as ev
from resolva.operators import models as M
from resolva.operators.encode import fit_encoder
from resolva.operators.folds import stratified_folds
from resolva.operators.packed import n_partitions, packed
from resolva.plans import training as TR
from resolva.schema import TARGET

FEATS = ["segmento_de_mercado", "grupo_problema"]
RATE = {"A": 0.15, "B": 0.35, "C": 0.5, "D": 0.65, "E": 0.85}


@pytest.fixture(scope="module")
def planted(spark):
    """Cases with a planted signal: y = 1 when the md5-uniform of the id is
    below a rate chosen by segment."""
    rate = F.create_map(*[x for k, v in RATE.items() for x in (F.lit(k), F.lit(v))])
    u = F.conv(F.substring(F.md5(F.col("case_id").cast("string")), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    seg = F.element_at(F.array(*[F.lit(k) for k in RATE]), (F.col("case_id") % 5 + 1).cast("int"))
    grp = F.concat(F.lit("g"), (F.col("case_id") % 7).cast("string"))
    df = (spark.range(0, 6000).withColumnRenamed("id", "case_id")
               .select("case_id", seg.alias("segmento_de_mercado"), grp.alias("grupo_problema"))
               .withColumn(TARGET, (u < rate[F.col("segmento_de_mercado")]).cast("int")))
    return df.filter(F.col("case_id") % 4 != 0).cache(), df.filter(F.col("case_id") % 4 == 0).cache()


def test_unseen_category_is_zero_vector(spark, planted):
    train, _ = planted
    encoder = fit_encoder(train, FEATS)
    new = spark.createDataFrame([(1, "ZZZ", "g1", 0), (2, "A", "g1", 0)], f"case_id long, {FEATS[0]} string, {FEATS[1]} string, {TARGET} int")
    rows = {r["case_id"]: r for r in encoder.transform(new, ["case_id"]).withColumn("v", vector_to_array("features")).collect()}
    assert sum(rows[1].v) == 1 and sum(rows[2].v) == 2 and len(rows[1].v) == encoder.width == 12
    assert rows[1].cells == [12, 6] and rows[2].cells == [0, 6]
    assert encoder.names()[6] == ("grupo_problema", "g1")


def test_logreg_beats_constant_baseline(spark, planted):
    train, test = planted
    model = M.fit(M.Spec(M.LOGREG, "logreg", "LR", {"C": 0.1}), train, FEATS)
    auc = ev.roc_auc(M.score(model, test, ["case_id"])).first()["roc_auc"]
    assert auc > 0.7
    coefs = {(r["variavel"], r["categoria"]): r["coeficiente"] for r in M.coefficient_weights(model).collect()}
    seg = [coefs[(FEATS[0], k)] for k in "ABCDE"]
    assert seg == sorted(seg)                 # monotone in the planted rate


def test_logreg_gradient_is_zero_at_the_fit(spark, planted):
    """The objective's gradient in numpy: mean weighted log loss plus the L2 term."""
    train, _ = planted
    model = M.fit(M.Spec(M.LOGREG, "logreg", "LR", {"C": 0.1}), train, FEATS)
    x, y = dense(model.encoder, train)
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, b = model.model.coefficients.toArray(), model.model.intercept
    slope = c * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert np.abs(slope @ x + w / (0.1 * len(y))).max() < 1e-3 and abs(slope.sum()) < 1e-3


def test_tree_and_importances(spark, planted):
    train, test = planted
    model = M.fit(M.Spec(M.TREE, "tree", "T", {"max_depth": 5, "min_samples_leaf": 50}), train, FEATS)
    assert ev.roc_auc(M.score(model, test, ["case_id"])).first()["roc_auc"] > 0.7
    imp = M.importance_weights(model).groupBy("variavel").agg(F.sum("importancia").alias("s"))
    s = {r["variavel"]: r["s"] for r in imp.collect()}
    assert s[FEATS[0]] > s[FEATS[1]]


def dense(encoder, df):
    rows = encoder.transform(df, ["case_id"]).orderBy("case_id").collect()
    x = np.zeros((len(rows), encoder.width + 1))
    x[np.arange(len(rows))[:, None], np.array([r.cells for r in rows])] = 1
    return x[:, :-1], np.array([r[TARGET] for r in rows], float)


def newton(x, y, C):
    """Squared hinge with a penalised intercept, by Newton steps."""
    x = np.c_[x, np.ones(len(y))]
    s, w = np.where(y == 1, 1.0, -1.0), np.zeros(x.shape[1])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(60):
        on = s * (x @ w) < 1
        a = x[on] * (2 * C * c[on])[:, None]
        gradient = w + a.T @ (x[on] @ w - s[on])
        w = w - np.linalg.solve(np.eye(len(w)) + a.T @ x[on], gradient)
    return w


def test_squared_hinge_equals_newton(spark, planted):
    train, _ = planted
    encoder = fit_encoder(train, FEATS)
    rows = encoder.transform(train, ["case_id"]).persist()
    w, b, share = svm.fit_squared_hinge(rows, encoder.width, 0.1, tol=1e-8)
    assert share <= 1e-8
    assert np.allclose([*w, b], newton(*dense(encoder, train), 0.1), atol=1e-6)
    other, _, _ = svm.fit_squared_hinge(rows.repartition(100), encoder.width, 0.1, tol=1e-8)      # partial sums added in a tree
    assert np.allclose(w, other, atol=1e-6)


def test_platt_svm_monotone_probabilities(spark, planted):
    train, test = planted
    fit = M.fit(M.Spec(M.SVM, "svm", "S", {"C": 0.1}), train, FEATS)
    assert len(fit.model.members) == 3 and all(m.slope > 0 and m.gradient_share <= 1e-6 for m in fit.model.members)
    sc = M.score(fit, test, ["case_id"])
    assert ev.roc_auc(sc).first()["roc_auc"] > 0.7
    ps = np.array([r["p"] for r in sc.select("p").collect()])
    assert ((ps > 0) & (ps < 1)).all()
    again = svm.CalibratedSVM.from_json(fit.model.to_json())
    assert all(np.array_equal(a.w, b.w) and (a.b, a.slope, a.shift) == (b.b, b.slope, b.shift)
               for a, b in zip(again.members, fit.model.members))


def boost_by_hand(x, y, rounds, depth, rate, floor):
    """Second-order boosting over dense 0/1 columns, all rows and columns."""
    base = np.log(y.mean() / (1 - y.mean()))
    z = np.full(len(y), base)

    def grow(rows, level, out, g, h):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth:
            for c in range(x.shape[1]):
                right = rows[x[rows, c] == 1]
                gr, hr = g[right].sum(), h[right].sum()
                gain = 0.5 * (gr ** 2 / (hr + 1) + (G - gr) ** 2 / (H - hr + 1) - G ** 2 / (H + 1))
                if hr >= floor and H - hr >= floor and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, c
        if best is None:
            out[rows] = -rate * G / (H + 1)
            return
        has = x[rows, best[1]] == 1
        grow(rows[~has], level + 1, out, g, h)
        grow(rows[has], level + 1, out, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0, step, p - y, p * (1 - p))
        z = z + step
    return 1 / (1 + np.exp(-z))


def test_boosting_equals_dense_version(spark, planted):
    train, _ = planted
    encoder = fit_encoder(train, FEATS)
    rows = encoder.transform(train, ["case_id"]).persist()
    model = boosting.fit(rows, encoder.width, rounds=13, depth=3, rate=0.3, floor=5.0, row_share=1.0, column_share=1.0)
    got = np.array([r.p for r in rows.withColumn("p", model.probability(spark)).orderBy("case_id").collect()])
    assert np.allclose(got, boost_by_hand(*dense(encoder, train), 13, 3, 0.3, 5.0), atol=1e-6)
    other = boosting.fit(rows.repartition(3), encoder.width, rounds=13, depth=3, rate=0.3, floor=5.0, row_share=1.0, column_share=1.0)
    assert other.to_json() == model.to_json()               # the same trees whatever the partitions


def test_boosting_recovers_a_planted_signal(spark, planted):
    train, test = planted
    model = M.fit(M.Spec(M.GBT, "gbt", "G", {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.3}), train, FEATS)
    assert ev.roc_auc(M.score(model, test, ["case_id"])).first()["roc_auc"] > 0.7
    gains = {r["variavel"]: r["s"] for r in M.importance_weights(model).groupBy("variavel").agg(F.sum("importancia").alias("s")).collect()}
    assert gains[FEATS[0]] > gains[FEATS[1]] and sum(gains.values()) == pytest.approx(1)
    cells = np.array([r.cells for r in model.encoder.transform(test, ["case_id"]).collect()])
    assert np.array_equal(boosting.Booster.from_json(model.model.to_json()).margins(cells), model.model.margins(cells))
    used = {c for t in model.model.trees for c in t.cell}
    assert used and max(used) < model.encoder.width


def test_trees_look_at_one_place_of_a_row():
    """A column's feature has one place in a row: a number at another place is not looked at."""
    tree = boosting.Tree()
    left, right = tree.split(0, 3, 1, 1.0)
    assert tree.leaf_of(np.array([[0, 3], [3, 4]])).tolist() == [right, left]


@pytest.mark.parametrize("n, slots, parts", [(0, 12, 1), (8_192, 12, 1), (8_193, 12, 2), (100_000, 12, 12), (500_000, 12, 12),
                                             (800_000, 12, 24), (65_537, 1, 2)])
def test_packed_partitions_follow_rows_and_slots(n, slots, parts):
    assert n_partitions(n, slots) == parts


def test_packed_rows_are_dealt_evenly(spark, planted):
    """However the rows come: many partitions, or all of them in one."""
    train, _ = planted
    encoder = fit_encoder(train, FEATS)
    many = spark.range(40_000).select(F.col("id").alias("case_id"), F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("id") % 5 + 1).cast("int")).alias(FEATS[0]),
                                      F.lit("g1").alias(FEATS[1]), F.lit(1).alias(TARGET))
    for rows in (many.repartition(50), many.coalesce(1)):
        blocks = packed(encoder.transform(rows, ["case_id"]))
        sizes = blocks.mapPartitions(lambda found: [sum(len(b.y) for b in found)]).collect()
        blocks.unpersist()
        assert len(sizes) == n_partitions(40_000, spark.sparkContext.defaultParallelism) and sum(sizes) == 40_000
        assert max(sizes) - min(sizes) <= 50


def test_row_and_column_shares():
    keys = np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 100_000)
    for number in (1, 2):
        assert abs((boosting._hash01(keys, number) < 0.8).mean() - 0.8) < 0.01
    both = (boosting._hash01(keys, 1) < 0.8) & (boosting._hash01(keys, 2) < 0.8)
    assert abs(both.mean() - 0.64) < 0.01                   # rounds draw apart


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_folds_differ_by_at_most_one(spark, digits):
    df = spark.range(10_001).select(F.when(F.col("id") % 5 == 0, 7).otherwise(F.col("id")).alias("case_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sizes = stratified_folds(df, "y", 4, digits=digits).groupBy("y", "_fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r.y == y]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    assert sum(r["count"] for r in sizes) == 10_001         # equal keys (a fifth of the rows) are dealt too


MORE_ROWS = 500_900       # more than the original flow's samples of 500,000 and 100,000 rows


@pytest.fixture(scope="module")
def many(spark):
    """Labelled rows with a category that only one row has, the last in the order of the seeded hash."""
    rows = spark.range(MORE_ROWS).select(F.col("id").alias("case_id"), (F.col("id") % 3 == 0).cast("int").alias(TARGET))
    last = rows.orderBy(F.md5(F.concat(F.lit("42:"), F.col("case_id").cast("string"))).desc()).first()["case_id"]
    return rows.select("*", F.when(F.col("case_id") == last, "rare").otherwise(F.concat(F.lit("s"), F.col("case_id") % 5)).alias(FEATS[0]),
                       F.concat(F.lit("g"), F.col("case_id") % 7).alias(FEATS[1]))


def test_every_training_row_is_encoded(many):
    encoder, rows = TR.encoded_rows(many, FEATS, "all-rows")
    assert rows.count() == MORE_ROWS and "rare" in encoder.labels[0]


@pytest.mark.parametrize("family", ["logreg", "tree", "gbt", "svm"])
def test_every_family_fits_on_all_training_rows(many, monkeypatch, family):
    class Reached(Exception):
        pass

    def fit(spec, rows, encoder):
        raise Reached(rows.count(), "rare" in encoder.labels[0])

    monkeypatch.setattr(M, "fit_encoded", fit)
    with pytest.raises(Reached) as found:
        TR.fitted(M.Spec(family, family, f"all-rows-{family}"), many, FEATS, key="all-rows")
    assert found.value.args == (MORE_ROWS, True)
