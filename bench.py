"""Benchmark the headline plans and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every timed step runs a full action into the no-op sink (no driver
collect). HTML is parsed once per corpus into a materialized element table
(the parse is timed separately), the way a production run would share it
across the intelligent (Q-A), media (Q-B) and text (Q-C) plans.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagefold.operators.metrics import alarm_evaluation, dashboard_stats, metrics_from_log  # noqa: E402
from pagefold.operators.page import links, page_header  # noqa: E402
from pagefold.plans.intelligent import intelligent  # noqa: E402
from pagefold.plans.media_pages import media_endpoint  # noqa: E402
from pagefold.plans.text_v4 import text_v4  # noqa: E402
from pagefold.session import get_spark, materialize, materialize_elements, table  # noqa: E402
from pagefold.sources.html import parse_pages  # noqa: E402
from pagefold.sources.logs import parse_log_lines, service_log_lines  # noqa: E402
from pagefold.sources.standin import ABOUT_PAGE_OFFSET, company_site, gallery_pages  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    times: dict[str, float] = {}
    counts: dict[str, int] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def spread(pages):
        """The test files hold one row group: deal their rows over the cores, as a crawl's many files would be."""
        return pages.repartition(int(cpus))

    # warm-up: JVM, Python workers, Arrow path
    run(parse_pages(table(spark, sf_dir, "pages").limit(20)))

    # raw crawl pages: parse once, then the page header + link count
    raw = timed("s2_parse_raw_pages", lambda: materialize_elements(parse_pages(spread(table(spark, sf_dir, "pages"))),
                                                                    "raw-el"))
    counts["raw_pages"] = table(spark, sf_dir, "pages").count()
    timed("p2_p7_page_header", lambda: run(page_header(raw).join(
        links(raw).groupBy("page_id").agg(F.count("*").alias("n_links")), "page_id", "left")))

    # company sites: parse once, Q-A and Q-C over the whole crawl
    site = timed("s2_parse_company_site", lambda: materialize_elements(parse_pages(spread(company_site(spark, sf_dir))),
                                                                        "site-el"))
    counts["site_pages"] = site.filter(F.col("tag") == "[document]").count()
    counts["home_pages"] = site.filter((F.col("tag") == "[document]") &
                                       (F.col("page_id") < ABOUT_PAGE_OFFSET)).count()
    timed("qa_intelligent", lambda: run(intelligent(site, max_about_pages=3)))
    timed("qc_v4_text", lambda: run(text_v4(site)))

    # galleries: parse once, Q-B every page's first media page
    gal = timed("s2_parse_gallery", lambda: materialize_elements(parse_pages(spread(gallery_pages(spark, sf_dir))),
                                                                  "gal-el"))
    counts["gallery_pages"] = gal.filter(F.col("tag") == "[document]").count()
    timed("qb_media_endpoint", lambda: run(media_endpoint(gal, None, 20)))

    # service log: metrics, dashboard windows and alarms
    log = timed("s13_parse_log", lambda: materialize(parse_log_lines(service_log_lines(spark, sf_dir)), "log"))
    timed("g10_dashboard_windows", lambda: run(dashboard_stats(metrics_from_log(log))))
    timed("w11_alarms", lambda: run(alarm_evaluation(metrics_from_log(log))))

    total = round(sum(times.values()), 3)
    qa_pages = counts["site_pages"]
    out = {
        "metric": "total_seconds_headline_plans",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "pages": counts,
        "pages_per_sec": {
            "qa_intelligent": round(qa_pages / (times["qa_intelligent"] + times["s2_parse_company_site"]), 1),
            "qc_v4_text": round(qa_pages / (times["qc_v4_text"] + times["s2_parse_company_site"]), 1),
            "qb_media_endpoint": round(counts["gallery_pages"] / (times["qb_media_endpoint"]
                                                                   + times["s2_parse_gallery"]), 1),
            "raw_header": round(counts["raw_pages"] / (times["p2_p7_page_header"]
                                                        + times["s2_parse_raw_pages"]), 1),
        },
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
