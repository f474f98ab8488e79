"""Joins of site content with analyzer answers, for companies and leads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from siteweave.fixed_values import (
    COMPLETED,
    ERROR_LIMIT,
    FAILED,
    LEAD_COMPANY_ATTRIBUTES,
    MIN_ANALYSIS_CHARS,
)
from siteweave.functions.analysis import (
    analysis_flat,
    display_name,
    parse_company_response,
    parse_lead_response,
)
from siteweave.functions.domains import (
    company_domain,
    company_domain_failure,
    extract_domain,
    record_domain,
)
from siteweave.functions.names import parse_email_name
from siteweave.functions.text import filled, or_empty
from siteweave.plans.skew import attach, mark_first
from siteweave.schemas import COMPANY_ANALYSIS, LEAD_ANALYSIS

Analyzer = Callable[[DataFrame], DataFrame]


def one_response(responses: DataFrame) -> DataFrame:
    """One answer per key: ``(key, response_text)``. Of several answers the smallest text counts."""
    return responses.groupBy("key").agg(F.min("response_text").alias("response_text"))


def company_analyses(responses: DataFrame) -> DataFrame:
    """Stored company answers as ``(domain, analysis)``, failed ones with a null analysis."""
    return one_response(responses).select(
        F.col("key").alias("domain"),
        parse_company_response(F.col("response_text")).alias("analysis"),
    )


def lead_analyses(responses: DataFrame) -> DataFrame:
    """Stored lead answers as ``(email, analysis)``."""
    return one_response(responses).select(
        F.col("key").alias("email"), parse_lead_response(F.col("response_text")).alias("analysis")
    )


def from_responses(responses: DataFrame) -> Analyzer:
    """The default analyzer: all stored answers; enriching joins them by domain."""
    analyses = company_analyses(responses)
    return lambda content: analyses


def from_batches(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Analyzer:
    """An analyzer from a function on pandas batches of ``(domain, content, emails)``.

    It returns ``domain`` and ``response_text`` (the wire form) and runs inside Spark's tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    def analyze(content: DataFrame) -> DataFrame:
        asked = content.select("domain", "content", "emails")
        answers = asked.mapInPandas(run, "domain string, response_text string")
        return answers.select(
            "domain", parse_company_response(F.col("response_text")).alias("analysis")
        )

    return analyze


def _askable() -> Column:
    """A site is analysed when its scrape succeeded with enough text."""
    enough = F.length(or_empty(F.col("content"))) >= MIN_ANALYSIS_CHARS
    return F.coalesce("success", F.lit(False)) & enough


def enrich_company(content: DataFrame, analyzer: Analyzer, enriched_at: Column) -> DataFrame:
    """Company stage record per content record.

    A failed scrape keeps a failed record with its reason; a missing, failed or impossible analysis
    (text under 50 characters) keeps a successful record without analysis.
    """
    analyses = analyzer(content.where(_askable())).select("domain", "analysis")
    slim = content.select("domain", "url", "success", "emails", "error", _askable().alias("askable"))
    reason = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("Unknown error"))
    ok = F.coalesce("success", F.lit(False))
    return slim.join(analyses, "domain", "left").select(
        "domain",
        enriched_at.alias("enriched_at"),
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("Scraping failed: "), reason)).alias("error"),
        F.when(ok, F.col("url")).alias("scraped_url"),
        F.when(ok, F.col("emails")).alias("emails_found"),
        F.when(F.col("askable"), F.col("analysis")).cast(COMPANY_ANALYSIS).alias("analysis"),
    )


def lead_rows(content: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per scraped address: ``(domain, pos, email, first_name, last_name, error, analysis)``.

    Only addresses of successful, non-empty content get an analysis. A plain join on the address is
    safe: an address lies at or below the domain it was found on, so it can occur for as many
    domains as its host has labels, never for many.
    """
    askable = F.col("success") & (or_empty(F.col("content")) != "")
    exploded = content.select(
        "domain", askable.alias("askable"), F.posexplode("emails").alias("pos", "email")
    )
    named = exploded.withColumn("name", parse_email_name(F.col("email")))
    return named.join(lead_analyses(responses), "email", "left").select(
        "domain",
        "pos",
        "email",
        F.col("name.first_name").alias("first_name"),
        F.col("name.last_name").alias("last_name"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("askable"), F.col("analysis")).cast(LEAD_ANALYSIS).alias("analysis"),
    )


def enrich_leads(content: DataFrame, responses: DataFrame, enriched_at: Column) -> DataFrame:
    """Lead stage record per domain; a domain without addresses keeps an empty list.

    The list of a domain has the length of the address array it came from.
    """
    lead = F.struct("pos", "email", "first_name", "last_name", "error", "analysis")
    per_domain = (
        lead_rows(content, responses)
        .groupBy("domain")
        .agg(F.array_sort(F.collect_list(lead)).alias("found"))
    )
    leads = F.transform(
        "found",
        lambda x: F.struct(
            *[x[f].alias(f) for f in ("email", "first_name", "last_name", "error", "analysis")]
        ),
    )
    return content.select("domain").join(per_domain, "domain", "left").select(
        "domain",
        enriched_at.alias("enriched_at"),
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
        F.coalesce(leads, F.expr("cast(array() as array<struct<email:string, first_name:string, "
                                 f"last_name:string, error:string, analysis:{LEAD_ANALYSIS}>>)")).alias(
            "leads"
        ),
    )


def domain_results(content: DataFrame, analyses: DataFrame) -> DataFrame:
    """Result per domain as the CRM-format exports take it: analysis fields, name, status, error."""
    # told before the join, so that who does not read the text does not move it
    told = content.withColumn("askable", _askable())
    joined = told.join(analyses.select("domain", "analysis"), "domain", "left")
    ok = F.coalesce("success", F.lit(False))
    done = F.col("askable") & F.col("analysis").isNotNull()
    reason = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("Scraping failed"))
    return joined.select(
        "domain",
        display_name(F.col("domain"), F.when(done, F.col("analysis.company_owner"))).alias("name"),
        *analysis_flat(F.col("analysis")),
        F.when(ok, F.col("content")).alias("site_content"),
        F.when(done, COMPLETED).otherwise(FAILED).alias("enrichment_status"),
        F.when(~ok, reason).when(~done, "Analysis failed").alias("enrichment_error"),
        F.when(ok, F.col("emails")).alias("scraped_emails"),
    )


def lead_company_attributes(
    leads: DataFrame, companies: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Leads ``(email, domain, …)`` with the attributes of their company; the domain names the company
    when there is none."""
    attributes = companies.groupBy("domain").agg(
        F.min(F.struct("name", *LEAD_COMPANY_ATTRIBUTES.values())).alias("c")
    )
    joined = attach(leads, attributes, "domain", "email", hot_rows=hot_rows)
    return joined.select(
        *leads.columns,
        F.coalesce("c.name", "domain").alias("company"),
        *[or_empty(F.col(f"c.{f}")).alias(a) for a, f in LEAD_COMPANY_ATTRIBUTES.items()],
    )


def domain_first_record(
    contacts: DataFrame, order: str, content: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Contacts in ``order`` with their domain and what a run does with them.

    The first contact of a domain is processed, later ones are already done, and one without a
    domain fails. With the ``content`` of the domains, every contact of a domain whose scrape failed
    fails too: a failed domain does not count as done.
    """
    keyed = contacts.withColumn("domain", record_domain(F.col("website"), F.col("email")))
    no_domain = F.when(F.col("domain").isNull(), "no_domain")
    return _run_states(keyed, order, no_domain, content, hot_rows)


def company_first_record(
    companies: DataFrame, order: str, content: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """The same for CRM companies; an unusable domain fails with its reason in ``failure``."""
    domain = company_domain(F.col("domain"), F.col("website"))
    keyed = companies.withColumn("domain", domain).withColumn(
        "failure", company_domain_failure(F.col("domain"))
    )
    return _run_states(
        keyed, order, F.when(F.col("failure").isNotNull(), "no_domain"), content, hot_rows
    )


def _run_states(
    keyed: DataFrame, order: str, unusable: Column, content: DataFrame | None, hot_rows: int | None
) -> DataFrame:
    marked = mark_first(keyed, "domain", order, "is_first")
    state = F.when(unusable.isNotNull(), unusable)
    if content is not None:
        scraped = content.select("domain", F.col("success").alias("scraped"))
        marked = attach(marked, scraped, "domain", order, hot_rows=hot_rows)
        state = state.when(~F.coalesce("scraped", F.lit(False)), "scrape_failed")
    state = state.when(F.col("is_first"), "process").otherwise("already_processed")
    return marked.withColumn("state", state).select(*keyed.columns, "state")


def bulk_companies(
    companies: DataFrame, results: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """CRM companies with the result of their domain, the source record kept in ``original_data``.

    ``results`` comes from :func:`domain_results`. Without a domain the row is an error
    (``error`` and ``error_type`` set).
    """
    source = companies.select(
        "id", "domain", F.to_json(F.struct(*companies.columns)).alias("original_data")
    ).withColumn("domain", F.nullif(F.col("domain"), F.lit("")))
    columns = [c for c in results.columns if c != "domain"]
    joined = attach(source, results, "domain", "id", hot_rows=hot_rows)
    missing = F.col("domain").isNull()
    return joined.select(
        "id",
        "domain",
        *columns,
        "original_data",
        F.when(missing, F.concat(F.lit("Company missing domain: "), F.col("original_data"))).alias(
            "error"
        ),
        F.when(missing, "ValueError").alias("error_type"),
    )


def bulk_leads(
    leads: DataFrame,
    content: DataFrame,
    responses: DataFrame,
    hot_rows: int | None = None,
) -> DataFrame:
    """CRM contacts with the content of their e-mail domain and their analysis, or with an error."""
    source = leads.select(
        "id", F.nullif(F.col("email"), F.lit("")).alias("email"),
        F.to_json(F.struct(*leads.columns)).alias("original_data"),
    ).withColumn("domain", extract_domain(F.col("email")))
    sites = content.select(
        "domain", F.col("success").alias("site_ok"), F.col("content").alias("site_content"),
        F.col("error").alias("site_error"),
    )
    # the narrow answers first: a site's text, which each of its leads gets, moves once
    answered = attach(source, lead_analyses(responses), "email", "id", hot_rows=hot_rows)
    joined = attach(answered, sites, "domain", "id", hot_rows=hot_rows, count_on=source)
    site_ok = F.coalesce("site_ok", F.lit(False))
    reason = F.coalesce("site_error", F.lit("no content for the domain"))
    problems = [
        (F.col("email").isNull(), F.concat(F.lit("Lead missing email: "), "original_data")),
        (
            F.col("domain").isNull(),
            F.concat(F.lit("Could not extract domain from email: "), "email"),
        ),
        (~site_ok, F.concat(F.lit("Failed to scrape "), "domain", F.lit(": "), reason)),
        (
            F.col("analysis").isNull(),
            F.concat(F.lit("Failed to analyze content for "), "email"),
        ),
    ]
    failed = reduce(lambda x, y: x | y, [condition for condition, _ in problems])
    message = reduce(lambda x, p: x.when(*p), problems[1:], F.when(*problems[0]))
    return joined.select(
        "id",
        "email",
        F.when(~failed, F.col("site_content")).alias("site_content"),
        F.when(~failed, COMPLETED).alias("enrichment_status"),
        F.col("analysis.buyer_persona").alias("buyer_persona"),
        F.col("analysis.lead_score_adjustment").alias("lead_score_adjustment"),
        "original_data",
        message.alias("error"),
        F.when(failed, "ValueError").alias("error_type"),
    )


def bulk_results(bulk: DataFrame) -> DataFrame:
    # tell failures by the short type: a test on the message would drag the whole record along
    return bulk.where(F.col("error_type").isNull()).drop("error", "error_type")


def bulk_errors(bulk: DataFrame) -> DataFrame:
    """Error records ``(item, error, type)``."""
    return bulk.where(F.col("error_type").isNotNull()).select(
        F.col("original_data").alias("item"), "error", F.col("error_type").alias("type")
    )


def apply_to_batches(
    df: DataFrame, fn: Callable[[dict], dict], schema: str
) -> DataFrame:
    """Apply any Python function to each record; failures become rows with ``error`` and ``type``.

    Results carry ``item`` (the record as JSON), the function's fields and null error columns.
    Runs batch-wise in Spark's tasks; prefer column expressions where they can say it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, record in zip(batch["item"], batch.drop(columns="item").to_dict("records")):
                try:
                    out.append({**fn(record), "item": item, "error": None, "type": None})
                except Exception as e:  # any failure of the plugged-in function is a result
                    out.append({"item": item, "error": str(e), "type": type(e).__name__})
            yield pd.DataFrame(out, columns=names)

    full = StructType.fromDDL(f"item string, {schema}, error string, type string")
    names = full.fieldNames()
    return df.withColumn("item", F.to_json(F.struct(*df.columns))).mapInPandas(run, full)


def failed_export_rows(errors: DataFrame) -> DataFrame:
    """Error records as export rows: the domain as name, status failed, the message cut at 255."""
    return errors.select(
        "domain",
        F.col("domain").alias("name"),
        F.lit(FAILED).alias("enrichment_status"),
        F.substring("error", 1, ERROR_LIMIT).alias("enrichment_error"),
    )


def leads_of_results(results: DataFrame, enriched_at: Column) -> DataFrame:
    """One lead per scraped address of a result, with the company attributes it exports."""
    known = [(a, f) for a, f in LEAD_COMPANY_ATTRIBUTES.items() if f in results.columns]
    return results.select(
        F.explode("scraped_emails").alias("email"),
        "domain",
        F.when(filled(F.col("name")), F.col("name")).otherwise(F.col("domain")).alias("company"),
        enriched_at.alias("enrichment_date"),
        *[or_empty(F.col(f)).alias(a) for a, f in known],
    )
