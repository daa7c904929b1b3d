"""Condensed physical plans of key queries → docs/PLANS.md.

    python tools/explain_plans.py [sf_dir]

Static plans (AQE off, so join/exchange choices are visible before runtime
re-planning); only operator lines that matter for scale are kept.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from resolva import registry as R  # noqa: E402
from resolva.operators import evaluate as ev  # noqa: E402
from resolva.session import get_spark  # noqa: E402

KEEP = re.compile(r"(Scan|Exchange|Join|Window|Aggregate|TakeOrdered|Generate|Expand|Union|Sort |"
                  r"MapInPandas|InMemory|ExistingRDD|WholeStageCodegen|\*\()")


def condensed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"Location: [^,]*, ", "", line)
        if len(line) > 230:
            line = line[:230] + " …"
        out.append(line)
    return "\n".join(out)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    names = ["rate_by_year", "top_segments", "modelling_set", "sample_fixed", "top_values_per_field",
             "threshold_sweep", "tuning_grid", "score_cases", "processing_catalog"]
    parts = ["# Physical plans (static, AQE off, condensed)\n",
             f"Generated by `tools/explain_plans.py` on `{sf}`. `*(n)` marks whole-stage codegen.\n"]
    for name in names:
        df = R.QUERIES[name](spark, sf)          # builds the base etc. with AQE on
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts.append(f"## {name}\n\n```\n{condensed(R.QUERIES[name](spark, sf))}\n```\n")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        del df
    scored = R._events_scored(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts.append(f"## roc_auc (score ladder)\n\n```\n{condensed(ev.roc_auc(scored))}\n```\n")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main(sys.argv)
