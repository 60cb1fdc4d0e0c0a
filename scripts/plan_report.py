"""Execute the headline plans and summarise their final (AQE) physical
plans into PLANS.md: shuffle stages, reused exchanges, aggregate kinds,
window/first-k operators, Python evaluation nodes, joins and scan filters.

usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pagefold.operators.metrics import alarm_evaluation, dashboard_stats, metrics_from_log  # noqa: E402
from pagefold.plans.intelligent import intelligent  # noqa: E402
from pagefold.plans.media_pages import media_endpoint  # noqa: E402
from pagefold.plans.text_v4 import text_v4  # noqa: E402
from pagefold.session import get_spark, materialize, materialize_elements  # noqa: E402
from pagefold.sources.html import parse_pages  # noqa: E402
from pagefold.sources.logs import parse_log_lines, service_log_lines  # noqa: E402
from pagefold.sources.standin import company_site, gallery_pages  # noqa: E402

PATTERNS = {
    "shuffle stages": r"ShuffleQueryStage",
    "reused exchanges": r"ReusedExchange",
    "broadcast exchanges": r"BroadcastQueryStage",
    "HashAggregate": r"\bHashAggregate\b",
    "SortAggregate": r"\bSortAggregate\b",
    "ObjectHashAggregate": r"\bObjectHashAggregate\b",
    "Window": r"\bWindow \[",
    "WindowGroupLimit": r"\bWindowGroupLimit\b",
    "SortMergeJoin": r"\bSortMergeJoin\b",
    "BroadcastHashJoin": r"\bBroadcastHashJoin\b",
    "Cartesian / nested-loop joins": r"CartesianProduct|BroadcastNestedLoopJoin",
    "Python (Arrow) nodes": r"ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroupsInPandas",
    "row-at-a-time Python UDF nodes": r"BatchEvalPython",
}


def summary(df) -> dict[str, int]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]          # AQE prints final, then initial
    return {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    site = materialize_elements(parse_pages(company_site(spark, sf_dir)), "plan-site")
    gal = materialize_elements(parse_pages(gallery_pages(spark, sf_dir)), "plan-gal")
    log = materialize(parse_log_lines(service_log_lines(spark, sf_dir)), "plan-log")
    plans = {
        "Q-A intelligent": intelligent(site),
        "Q-B media endpoint": media_endpoint(gal, None, 20),
        "Q-C v4 text": text_v4(site),
        "G10 dashboard windows": dashboard_stats(metrics_from_log(log)),
        "W11 alarms": alarm_evaluation(metrics_from_log(log)),
    }
    rows = {name: summary(df) for name, df in plans.items()}
    out = ["# Physical plan summary", "",
           f"Final adaptive plans of the headline plans over materialized element tables ({sf_dir}),",
           "generated by `scripts/plan_report.py`. Counts are operator occurrences in the executed plan.", "",
           "| operator | " + " | ".join(plans) + " |", "|---|" + "---|" * len(plans)]
    for k in PATTERNS:
        out.append(f"| {k} | " + " | ".join(str(rows[n][k]) for n in plans) + " |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
