"""Shapes the plans must have: what is read, what is shuffled, what is never used."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["combine_pages", "crawl_pages", "domain_list_reject", "enrich_company", "enrich_leads", "lookup_company",
     "lookup_contact", "import_all_summary", "bulk_lead_results", "stage_status", "batch_progress"],
)
def test_no_pair_joins(spark, name):
    assert not re.search("CartesianProduct|NestedLoop|Python", plan(spark, name))


def test_scans_read_only_what_they_need(spark):
    assert "html" not in plan(spark, "domain_list_accept")
    assert re.search(r"FileScan parquet \[c_custkey#\d+L,c_acctbal#\d+\]", plan(spark, "lead_status"))


def test_filters_reach_the_scan(spark):
    scans = [line for line in plan(spark, "import_company_actions").split("\n") if "o_orderkey" in line]
    assert any("DataFilters: [(NOT (o_orderstatus" in line for line in scans if "FileScan" in line)


def test_reports_pre_aggregate(spark):
    for name in ("scrape_report", "enrichment_coverage", "batch_summary"):
        text = plan(spark, name)
        assert text.count("HashAggregate") == 2 and text.count("Exchange SinglePartition") == 1
