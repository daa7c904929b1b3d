import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from resolva.operators import evaluate as ev
from resolva.operators import models as M
from resolva.operators.splits import SplitSpec, temporal_splits
from resolva.plans import final as FN
from resolva.plans import training as TR
from resolva.plans.evaluation import metric_rows
from resolva.schema import FEATURES
from resolva.session import scratch_path
from resolva.sources.base import cleaned_base
from resolva.sources.publish import publish, published, rows_fingerprint
from tests.conftest import SF_SMALL

SPEC = SplitSpec()


@pytest.fixture(scope="module")
def splits(spark):
    return temporal_splits(cleaned_base(spark, SF_SMALL), SPEC, FEATURES)


def test_final_model_is_the_best_by_probability(spark, splits):
    final = FN.finalize(splits, SPEC, FN.RateFamily(), FEATURES)
    valid = final.metrics.filter("conjunto = 'validacao'").toPandas().sort_values(["brier_score", "log_loss"])
    assert final.configuracao == valid.iloc[0].configuracao and len(valid) == 6
    assert final.features == FEATURES and final.threshold == valid.iloc[0].threshold
    again = final.score(splits["test"], ["case_id"])
    both = again.join(final.predictions, "case_id")
    assert both.count() == splits["test"].count() == final.predictions.count()
    assert both.filter((F.col("p") != F.col("y_proba")) | (F.col("y") != F.col("y_true"))
                       | ((F.col("p") >= final.threshold).cast("int") != F.col("y_pred"))).count() == 0


def test_split_years_rows_and_candidates_make_other_versions(spark, splits):
    first = FN.finalize(splits, SPEC, FN.RateFamily(), FEATURES).marker
    assert FN.finalize(splits, SPEC, FN.RateFamily(), FEATURES).marker == first
    years = SplitSpec(1996, 1999, 2000, 2001)
    other = FN.finalize(temporal_splits(cleaned_base(spark, SF_SMALL), years, FEATURES), years, FN.RateFamily(), FEATURES).marker
    fewer = FN.finalize(splits, SPEC, FN.RateFamily(FN.RATE_GRID[:2]), FEATURES).marker
    less = dict(splits, train=splits["train"].filter("case_id % 10 <> 0"))
    changed = FN.finalize(less, SPEC, FN.RateFamily(), FEATURES).marker
    assert len({m["path"] for m in (first, other, fewer, changed)}) == 4


def test_fitted_models_are_published_and_loaded(spark, splits):
    specs = [M.Spec(M.LOGREG, "logreg", "LR", {"C": 0.1}), M.Spec(M.GBT, "gbt", "G", {"n_estimators": 3, "max_depth": 2}),
             M.Spec(M.SVM, "svm", "S", {"C": 0.1}), M.Spec(M.TREE, "tree", "T", {"max_depth": 4, "min_samples_leaf": 20})]
    scored = TR.scored_splits(splits, specs, FEATURES)
    assert scored.count() == 4 * (splits["valid"].count() + splits["test"].count())
    for spec in specs:
        final = FN.finalize(splits, SPEC, FN.ModelFamily([spec]), FEATURES)
        loaded = final.score(splits["test"], ["case_id"]).join(final.predictions, "case_id")
        assert final.configuracao == spec.config and final.predictions.count() == splits["test"].count()
        assert loaded.filter(F.abs(F.col("p") - F.col("y_proba")) > 1e-12).count() == 0


SECOND = """
import json, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
from resolva.operators import models as M
from resolva.operators.splits import SplitSpec, temporal_splits
from resolva.plans import final as FN, training as TR
from resolva.schema import FEATURES
from resolva.sources.base import cleaned_base
splits = temporal_splits(cleaned_base(spark, sys.argv[3]), SplitSpec(), FEATURES)
final = FN.finalize(splits, SplitSpec(), FN.RateFamily(), FEATURES)
print("KEYS", json.dumps([final.marker["path"].split("/")[-2:], TR.training_key(splits["train"], FEATURES)]))
"""


def test_a_second_session_loads_the_first_ones_fit(spark, splits):
    """Another process with other partition counts finds the same keys and version."""
    final = FN.finalize(splits, SPEC, FN.RateFamily(), FEATURES)
    folder = spark.conf.get("spark.checkpoint.dir")
    run = subprocess.run([sys.executable, "-c", SECOND, os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder, SF_SMALL],
                         capture_output=True, text=True, timeout=300)
    line = [x for x in run.stdout.splitlines() if x.startswith("KEYS ")]
    assert line, run.stderr[-2000:]
    assert json.loads(line[0][5:]) == [final.marker["path"].split("/")[-2:], TR.training_key(splits["train"], FEATURES)]


def test_publish_is_whole_or_nothing(spark):
    root = scratch_path(spark, "publish-test")

    def fails(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish(spark, root, fails)
    assert published(spark, root) is None

    def racing(path):
        """Another writer is done while this one still writes."""
        if not inner:
            inner.append(publish(spark, root, lambda p: spark.range(5).write.parquet(p)))
        spark.range(7).write.parquet(path)

    inner = []
    found = publish(spark, root, racing)
    assert found == inner[0] == published(spark, root)
    assert spark.read.parquet(found["path"]).count() == 5


def test_fingerprint_knows_values_not_order(spark):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    assert rows_fingerprint(a) == rows_fingerprint(a.orderBy(F.rand()).repartition(5).select("x", "id"))
    assert rows_fingerprint(a) != rows_fingerprint(a.withColumn("x", F.when(F.col("id") == 500, 99).otherwise(F.col("x"))))
    assert rows_fingerprint(a) != rows_fingerprint(a.unionByName(a.limit(1)))


def test_metric_rows_reads_scored_rows_once(spark, tmp_path):
    """One scan of the scored rows; the rest of the plan reads counts."""
    path = str(tmp_path / "scored")
    (spark.range(4000).select(F.when(F.col("id") % 2 == 0, "validacao").otherwise("teste").alias("conjunto"), F.lit("m").alias("modelo"),
                              (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 97 / 100).alias("p")).write.parquet(path))
    scored = spark.read.parquet(path)
    counts = ev.score_counts(scored, ["conjunto", "modelo"], clip=True)
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out = metric_rows(scored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and out.count() == 2
    day1, day2 = scored.filter("p < 0.3 or y = 1"), scored.filter("not (p < 0.3 or y = 1)")
    parts = ev.add_counts([ev.score_counts(d, ["conjunto", "modelo"], clip=True) for d in (day1, day2)], ["conjunto", "modelo"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, counts.collect()))


def test_scoring_stream_replays_a_batch_without_repeats(spark, splits, tmp_path):
    from resolva.operators.clean import clean_schema
    from resolva.sources.base import base_path
    from resolva.streaming.scoring import run_scoring, score_batch
    final, years = FN.finalize(splits, SPEC, FN.RateFamily(), FEATURES), (SPEC.test_year, SPEC.test_year)
    parts, out, ckpt = base_path(spark, SF_SMALL), str(tmp_path / "scores"), str(tmp_path / "ckpt")
    first = sorted(map(tuple, run_scoring(spark, final, parts, clean_schema(), out, ckpt, years).collect()))
    assert len(first) == splits["test"].count()
    score_batch(final, cleaned_base(spark, SF_SMALL), out, 0, years)              # the batch comes again
    again = run_scoring(spark, final, parts, clean_schema(), out, ckpt, years)    # and nothing new has arrived
    assert sorted(map(tuple, again.collect())) == first
    want = final.predictions.select("case_id", "modelo", "y_proba", "y_pred")
    assert sorted(map(tuple, want.collect())) == first


def test_all_configurations_fit_from_one_encoding(spark, splits):
    specs = [M.Spec(M.LOGREG, "logreg", f"LR_{c}", {"C": c}) for c in (0.1, 1.0)] + [M.Spec(M.TREE, "tree", "T", {"max_depth": 3})]
    key = TR.training_key(splits["train"], FEATURES)
    fits = [TR.fitted(s, splits["train"], FEATURES, key=key) for s in specs]
    folder = scratch_path(spark, f"models/{key}")
    encodings = [x for x in os.listdir(folder) if x.startswith("encoded-")]
    assert len(encodings) == 1 and len({tuple(map(tuple, f.encoder.labels)) for f in fits}) == 1
    out = M.score_all(fits, splits["valid"], ["case_id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {len(x) > 1 for x in fits[0].encoder.labels} == {True}                 # all 14 features vary
    assert len(fits[0].encoder.features) == 14
