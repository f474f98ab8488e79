"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siteweave.catalog.registry import QUERIES
from siteweave.plans.session import local_session

HEADLINE = [
    "html_to_text", "extract_emails", "extract_links", "combine_pages", "crawl_pages",
    "domain_list_reject", "enrich_company", "enrich_leads", "lead_company_attributes",
    "import_company_actions", "lookup_company", "bulk_lead_results", "scrape_report",
    "batch_progress", "crm_company_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "siteweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query, runs = QUERIES[name][0], []
        for _ in range(4):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # the first run warms up
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
