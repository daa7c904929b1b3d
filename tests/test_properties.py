"""Property tests: distributed metrics equal brute force on random scored sets."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, Phase, example, given, settings
from hypothesis import strategies as st

from resolva.operators import evaluate as ev

scores = st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.5, 0.75, 0.9, 1.0]) | st.floats(0, 1),
                            st.integers(0, 1)), min_size=2, max_size=60)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@example(rows=[(0.0, 0), (0.0, 0)], buckets=1, parts=1)
@example(rows=[(0.5, 1), (0.5, 0), (0.2, 0)], buckets=1, parts=2)
@given(rows=scores, buckets=st.integers(1, 9), parts=st.integers(1, 6))
def test_auc_and_sweep_property(spark, rows, buckets, parts):
    pdf = pd.DataFrame(rows, columns=["p", "y"])
    df = spark.createDataFrame(pdf).repartition(parts)
    p, y = pdf.p.to_numpy(), pdf.y.to_numpy()
    pos, neg = p[y == 1], p[y == 0]
    got = ev.roc_auc(df, buckets=buckets).first()["roc_auc"]
    if len(pos) == 0 or len(neg) == 0:
        assert got is None
    else:
        ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert abs(got - ref) < 1e-12
    sw = ev.threshold_sweep(df).orderBy("i").toPandas()
    tp = [int(((p >= t) & (y == 1)).sum()) for t in ev.THRESHOLDS]
    fp = [int(((p >= t) & (y == 0)).sum()) for t in ev.THRESHOLDS]
    assert list(sw.tp) == tp and list(sw.fp) == fp
