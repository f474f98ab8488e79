"""Stored pages to page records, and page records to one content record per domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.fixed_values import NO_PAGES, NO_SUCCESSFUL_PAGES, PAGE_HEADER
from siteweave.functions.domains import url_host
from siteweave.functions.html import (
    extract_emails,
    html_to_text,
    page_error,
    page_success,
)
from siteweave.functions.text import strip


def scrape(pages: DataFrame) -> DataFrame:
    """Text, addresses and outcome of every page; the HTML is dropped in the same stage.

    Addresses belong to the page's own host, not to the domain a crawl started from.
    """
    text = F.when(F.col("html").isNotNull(), html_to_text(F.col("html"))).otherwise("")
    fetch_error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    read = pages.withColumns(
        {"content": text, "emails": extract_emails(F.col("html"), url_host(F.col("url")))}
    )
    ok = page_success(F.col("content")) & F.nullif(fetch_error, F.lit("")).isNull()
    return read.withColumns(
        {"success": ok, "error": page_error(F.col("content"), fetch_error)}
    ).drop("html")


def combine_pages(ranked: DataFrame) -> DataFrame:
    """One content row per domain from all its pages (``rank`` orders the pages of a domain).

    A crawl has bounded the pages of a domain already; nothing is left out here. Texts of successful
    pages are joined in rank order under a header with their URL; addresses are united.
    """
    header = F.format_string(PAGE_HEADER, F.col("url"))
    usable = F.col("success") & (F.col("content") != "")
    part = F.when(
        usable,
        F.struct(
            "rank",
            F.concat(header, F.col("content")).alias("section"),
            F.coalesce("emails", F.expr("cast(array() as array<string>)")).alias("emails"),
        ),
    )
    grouped = (
        ranked.groupBy("domain")
        .agg(
            F.min_by("url", "rank").alias("url"),
            F.collect_list(part).alias("parts"),
            F.count(F.lit(1)).alias("pages_scraped"),
            F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("visited"),
        )
    )
    parts = F.array_sort("parts")
    some = F.size("parts") > 0
    joined = F.array_join(F.transform(parts, lambda p: p["section"]), "")
    return grouped.select(
        "domain",
        "url",
        strip(joined).alias("content"),
        some.alias("success"),
        F.when(~some, NO_SUCCESSFUL_PAGES).alias("error"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["emails"])))).alias(
            "emails"
        ),
        "pages_scraped",
        F.transform("visited", lambda v: v["url"]).alias("scraped_urls"),
    )


def with_missing_domains(combined: DataFrame, domains: DataFrame) -> DataFrame:
    """Add a failed record for every requested domain without any crawled page."""
    full = domains.select("domain").distinct().join(combined, "domain", "left")
    none = F.col("success").isNull()
    empty = F.expr("cast(array() as array<string>)")
    return full.select(
        "domain",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.when(none, NO_PAGES).otherwise(F.col("error")).alias("error"),
        F.coalesce("emails", empty).alias("emails"),
        F.coalesce("pages_scraped", F.lit(0)).alias("pages_scraped"),
        F.coalesce("scraped_urls", empty).alias("scraped_urls"),
    )


def site_content_record(content: DataFrame, scraped_at: Column) -> DataFrame:
    """Stage record of a domain: text only on success, error only on failure, addresses always."""
    return content.select(
        "domain",
        "url",
        "success",
        scraped_at.alias("scraped_at"),
        F.when(F.col("success"), F.col("content")).otherwise("").alias("content"),
        "emails",
        F.when(~F.col("success"), F.col("error")).alias("error"),
    )
