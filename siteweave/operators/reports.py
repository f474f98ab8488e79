"""Reports: one pre-aggregated row (or one per group) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteweave.fixed_values import (
    BATCH_ERROR_LIMIT,
    COMPLETED,
    PROGRESS_STEP,
    TOP_ERROR_LIMIT,
)
from siteweave.functions.text import filled, or_empty, round_1
from siteweave.plans.running import running_counts


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _percent(part: Column, total: Column) -> Column:
    """Share in percent, one decimal; 0 for an empty total."""
    return F.coalesce(round_1(part.cast("double") / F.nullif(total, F.lit(0)) * 100), F.lit(0.0))


def scrape_report(metrics: DataFrame) -> DataFrame:
    """Totals of a scrape run. Durations of zero do not count; sizes only of successes do."""
    took = F.nullif(F.col("duration"), F.lit(0.0))
    ok = F.coalesce("success", F.lit(False))
    summed = metrics.agg(
        F.count(F.lit(1)).alias("total_domains"),
        F.count_if(ok).alias("successful_scrapes"),
        F.count_if(~ok).alias("failed_scrapes"),
        # exact sums: the result does not depend on the order of the partial sums
        F.sum(took.cast("decimal(28,6)")).alias("d"),
        F.count(took).alias("n"),
        F.min(took).alias("lo"),
        F.max(took).alias("hi"),
        F.sum(F.when(ok, F.col("content_size"))).alias("content"),
        F.sum(F.when(ok, F.col("emails_found"))).alias("emails"),
    )
    zero, d = F.lit(0.0), F.col("d").cast("double")
    total = F.col("total_domains")
    return summed.select(
        "total_domains",
        "successful_scrapes",
        "failed_scrapes",
        F.coalesce(d, zero).alias("total_duration"),
        F.coalesce(d / F.nullif(F.col("n"), F.lit(0)), zero).alias("average_duration"),
        F.coalesce("lo", zero).alias("min_duration"),
        F.coalesce("hi", zero).alias("max_duration"),
        F.when(d > 0, total / d * 60).otherwise(zero).alias("domains_per_minute"),
        _long(F.col("content")).alias("total_content_size"),
        _long(F.col("emails")).alias("total_emails_found"),
        F.coalesce(
            F.col("successful_scrapes") / F.nullif(total, F.lit(0)), zero
        ).alias("success_rate"),
    )


def scrape_errors(metrics: DataFrame) -> DataFrame:
    """Failures per error text."""
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("Unknown"))
    failed = metrics.where(~F.coalesce("success", F.lit(False)))
    return failed.groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("failures"))


def _enriched() -> Column:
    return F.coalesce(F.col("enrichment_status") == COMPLETED, F.lit(False))


def _located() -> Column:
    return filled(F.col("city")) | filled(F.col("state")) | filled(F.col("country"))


def enrichment_coverage(companies: DataFrame) -> DataFrame:
    """How much of the CRM is enriched. Site content counts on any record."""
    done = _enriched()
    counted = companies.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("enriched"),
        F.count_if(done & filled(F.col("description"))).alias("with_description"),
        F.count_if(done & _located()).alias("with_location"),
        F.count_if(filled(F.col("site_content"))).alias("with_site_content"),
    )
    return counted.select(
        "*",
        _percent(F.col("enriched"), F.col("total")).alias("enriched_percent"),
        (F.col("total") - F.col("enriched")).alias("remaining"),
    )


def enrichment_summary(companies: DataFrame) -> DataFrame:
    """Coverage variant: all details count on enriched records, and records without a site apart."""
    done = _enriched()
    no_domain = ~done & ~filled(F.col("domain")) & ~filled(F.col("website"))
    counted = companies.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("enriched"),
        F.count_if(no_domain).alias("no_domain"),
        F.count_if(done & filled(F.col("site_content"))).alias("has_content"),
        F.count_if(done & filled(F.col("description"))).alias("has_description"),
        F.count_if(done & _located()).alias("has_location"),
        F.count_if(done & filled(F.col("numberofemployees"))).alias("has_employees"),
        F.count_if(done & filled(F.col("annualrevenue"))).alias("has_revenue"),
        F.count_if(done & filled(F.col("industry"))).alias("has_industry"),
    )
    return counted.select(
        "*",
        _percent(F.col("enriched"), F.col("total")).alias("enriched_percent"),
        (F.col("total") - F.col("enriched") - F.col("no_domain")).alias("remaining"),
    )


def recent_enriched(companies: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The last enriched companies in ``order``, with a short description."""
    return (
        companies.where(_enriched())
        .orderBy(F.desc(order))
        .limit(limit)
        .select(
            order, "name", F.substring(or_empty(F.col("description")), 1, 100).alias("description"),
            "city", "state", "industry",
        )
    )


def _batch_flags() -> dict[str, Column]:
    no_domain = ~filled(F.col("domain")) & ~filled(F.col("website"))
    enriched = ~no_domain & F.coalesce("enriched", F.lit(False))
    failed = ~no_domain & ~F.coalesce("enriched", F.lit(False))
    timeout = failed & F.coalesce(F.lower("error").contains("timeout"), F.lit(False))
    return {"enriched": enriched, "failed": failed, "no_domain": no_domain, "timeout": timeout}


def batch_summary(outcomes: DataFrame, elapsed_seconds: float) -> DataFrame:
    """Outcome of a batch run. ``outcomes``: domain, website, enriched, error."""
    counted = outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(flag).alias(f"{name}_count") for name, flag in _batch_flags().items()],
    )
    total = F.greatest(F.col("total"), F.lit(1))
    return counted.select(
        "total",
        F.col("enriched_count").alias("enriched"),
        F.col("failed_count").alias("failed"),
        F.col("no_domain_count").alias("no_domain"),
        F.col("timeout_count").alias("timeout"),
        round_1(F.col("enriched_count").cast("double") / total * 100).alias("enriched_percent"),
        round_1(F.lit(float(elapsed_seconds)) / total).alias("seconds_per_company"),
    )


def batch_progress(outcomes: DataFrame, run: str, seq: str, chunk: int = 100_000) -> DataFrame:
    """Running state at every fifth processed record of each run.

    Records without a domain count in the total but report nothing. Two-level running counts keep
    every window short, however long a run is.
    """
    flags = {"done": _batch_flags()["enriched"], "total": F.lit(True)}
    counted = running_counts(outcomes, run, seq, flags, chunk)
    return counted.where(
        (F.col("total") % PROGRESS_STEP == 0)
        & (filled(F.col("domain")) | filled(F.col("website")))
    ).select(
        run,
        seq,
        F.col("done").alias("enriched"),
        "total",
        round_1(F.col("done").cast("double") / F.col("total") * 100).alias("enriched_percent"),
    )


def top_errors(outcomes: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first errors of a run, as shown: at most 100 characters of the kept 200."""
    kept = F.substring(F.substring("error", 1, BATCH_ERROR_LIMIT), 1, TOP_ERROR_LIMIT)
    return (
        outcomes.where(filled(F.col("error")))
        .orderBy(order)
        .limit(limit)
        .select(order, "company", kept.alias("error"))
    )


def import_summary(records: DataFrame, actions: DataFrame, object_type: str) -> DataFrame:
    """Result row of an import. ``total`` includes the skipped rows.

    ``actions`` may carry an ``error`` column filled by whatever applied them; those rows failed.
    The error texts are a table of their own, see :func:`import_errors`.
    """
    failed = filled(F.col("error")) if "error" in actions.columns else F.lit(False)
    per_kind = actions.agg(
        F.count_if((F.col("action") == "create") & ~failed).alias("imported"),
        F.count_if((F.col("action") == "update") & ~failed).alias("updated"),
        F.count_if(failed).alias("failed"),
    )
    zero = F.lit(0).cast("long")
    counts = [
        records.agg(F.count(F.lit(1)).alias("total")).select(
            "total", zero.alias("imported"), zero.alias("updated"), zero.alias("failed")
        ),
        per_kind.select(zero.alias("total"), "imported", "updated", "failed"),
    ]
    summed = counts[0].unionByName(counts[1]).agg(
        *[F.sum(c).alias(c) for c in ("total", "imported", "updated", "failed")]
    )
    return summed.select(
        F.lit(COMPLETED).alias("status"), F.lit(object_type).alias("object_type"), "*"
    )


def import_errors(actions: DataFrame, object_type: str) -> DataFrame:
    """One message per failed action."""
    return actions.where(filled(F.col("error"))).select(
        "seq",
        F.format_string(f"Failed to import {object_type} %s: %s", "key", "error").alias("message"),
    )


def import_marker(spark: SparkSession, status: str, detail: str, text: str) -> DataFrame:
    """Result row of an import that did not run: ``skipped`` with a reason or ``error`` with its text."""
    return spark.range(1).select(F.lit(status).alias("status"), F.lit(text).alias(detail))


def import_all_summary(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """Company and lead import results in one row."""
    both = companies.withColumn("part", F.lit("companies")).unionByName(
        leads.withColumn("part", F.lit("leads"))
    )
    fields = ["total", "imported", "updated", "failed"]
    return both.agg(
        F.lit(COMPLETED).alias("status"),
        *[
            F.max(F.when(F.col("part") == part, F.col(f))).alias(f"{part}_{f}")
            for part in ("companies", "leads")
            for f in fields
        ],
    )


def processing_stats(results: DataFrame) -> DataFrame:
    """Run totals: domains, outcomes and found addresses."""
    done = F.coalesce(F.col("enrichment_status") == COMPLETED, F.lit(False))
    found = F.coalesce(F.size("scraped_emails"), F.lit(0))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("enriched"),
        F.count_if(~done).alias("failed"),
        _long(F.sum(F.greatest(found, F.lit(0)))).alias("total_leads"),
    )


def stage_status(
    domains: DataFrame, scraped: DataFrame, companies: DataFrame, leads: DataFrame
) -> DataFrame:
    """Per domain: did its scrape, company and lead stage succeed, and which step failed.

    Without a scrape nothing later counts. The stage tables have one row per domain.
    """
    joined = (
        domains.select("domain")
        .distinct()
        .join(scraped.select("domain", F.col("success").alias("s"), "error"), "domain", "left")
        .join(companies.select("domain", F.col("success").alias("c")), "domain", "left")
        .join(leads.select("domain", F.col("success").alias("l")), "domain", "left")
    )
    s = F.coalesce("s", F.lit(False))
    return joined.select(
        "domain",
        F.when(s, "completed").otherwise("failed").alias("status"),
        F.when(~s, "scrape").alias("step"),
        F.when(~s, F.coalesce("error", F.lit("not scraped"))).alias("error"),
        s.alias("scrape_success"),
        (s & F.coalesce("c", F.lit(False))).alias("company_enrichment_success"),
        (s & F.coalesce("l", F.lit(False))).alias("leads_enrichment_success"),
    )


def export_counts(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """Number of exported company and lead rows."""
    kinds = companies.select(F.lit("companies").alias("export")).unionByName(
        leads.select(F.lit("leads").alias("export"))
    )
    return kinds.agg(
        F.count_if(F.col("export") == "companies").alias("companies_written"),
        F.count_if(F.col("export") == "leads").alias("leads_written"),
    )
