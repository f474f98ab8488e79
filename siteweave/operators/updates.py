"""What the enrichment runs send to the CRM, as action rows ``(object_type, id, action, properties)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.fixed_values import DESCRIPTION_LIMIT
from siteweave.functions.analysis import lead_status, lifecycle_stage
from siteweave.functions.crm import company_update_properties
from siteweave.functions.text import or_empty
from siteweave.operators.enrich import company_first_record, domain_first_record, lead_analyses
from siteweave.plans.skew import attach

_NOT_SENT = {"id", "original_data", "scraped_emails", "error", "error_type"}


def _update(object_type: str, properties: Column) -> list[Column]:
    return [
        F.lit(object_type).alias("object_type"), F.col("id"), F.lit("update").alias("action"), properties.alias("properties")
    ]


def bulk_company_updates(bulk: DataFrame) -> DataFrame:
    """Updates of a bulk company run: every field of a result, empty ones as null. Error rows send nothing."""
    fields = [c for c in bulk.columns if c not in _NOT_SENT]
    entries = [v for c in fields for v in (F.lit(c), F.col(c).cast("string"))]
    return bulk.where(F.col("error_type").isNull()).select(*_update("companies", F.create_map(*entries)))


def bulk_lead_updates(bulk: DataFrame) -> DataFrame:
    """Updates of a bulk lead run: site text, status, persona and score. Error rows send nothing."""
    values = {
        "site_content": or_empty(F.col("site_content")),
        "enrichment_status": or_empty(F.col("enrichment_status")),
        "buyer_persona": or_empty(F.col("buyer_persona")),
        "lead_score_adjustment": F.coalesce("lead_score_adjustment", F.lit(0)).cast("string"),
    }
    entries = [v for name, value in values.items() for v in (F.lit(name), value)]
    return bulk.where(F.col("error_type").isNull()).select(*_update("contacts", F.create_map(*entries)))


def _outcome(content: DataFrame, judged: DataFrame, order: str, unusable: Column, hot_rows: int | None) -> DataFrame:
    """Rows with a state, and why those without an update have none, as far as domain and scrape tell.

    Only the outcome of a scrape is joined here, never its text.
    """
    reasons = content.select("domain", F.concat(F.lit("Scraping failed: "), F.coalesce("error", F.lit("None"))).alias("scrape_error"))
    told = attach(judged, reasons, "domain", order, hot_rows=hot_rows)
    reason = (
        F.when(F.col("state") == "no_domain", unusable)
        .when(F.col("state") == "scrape_failed", F.coalesce("scrape_error", F.lit("Scraping failed: not scraped")))
    )
    return told.withColumn("reason", reason).drop("scrape_error")


def _actions(object_type: str, rows: DataFrame, properties: Column, analysed: Column) -> DataFrame:
    sent = (F.col("state") == "process") & analysed
    failed = (F.col("state") == "process") & ~analysed
    state = F.when(sent, "completed").when(failed, "analysis_failed").otherwise(F.col("state"))
    return rows.select(
        F.lit(object_type).alias("object_type"),
        "id",
        F.when(sent, "update").alias("action"),
        state.alias("state"),
        F.when(failed, "Analysis failed").otherwise(F.col("reason")).alias("reason"),
        F.when(sent, properties).alias("properties"),
    )


def company_enrichment(
    companies: DataFrame, order: str, content: DataFrame, analyses: DataFrame, enriched_at: Column, hot_rows: int | None = None
) -> DataFrame:
    """One run over CRM companies in ``order``: ``(object_type, id, action, state, reason, properties)``.

    The first company of a domain is scraped and analysed, later ones count as done and send nothing. A
    domain that cannot be used or scraped, and a failed analysis, give a reason instead of an update.
    The text of a site is cut before it moves and meets one row: the company that is processed for it.
    """
    narrow = companies.select(order, "id", "domain", "website")
    judged = company_first_record(narrow, order, content, hot_rows)
    told = _outcome(content, judged, order, F.col("failure"), hot_rows)
    texts = content.select("domain", F.substring("content", 1, DESCRIPTION_LIMIT).alias("text"))
    answers = analyses.where(F.col("analysis").isNotNull()).select("domain", "analysis")
    known = texts.join(answers, "domain").select(F.col("domain").alias("of"), "text", "analysis")
    # one row a domain on both sides
    mine = F.when(F.col("state") == "process", F.col("domain"))
    rows = told.withColumn("mine", mine).join(known, F.col("mine") == F.col("of"), "left")
    properties = company_update_properties(F.col("analysis"), F.col("text"), enriched_at)
    return _actions("companies", rows, properties, F.col("analysis").isNotNull())


def lead_enrichment(
    contacts: DataFrame, order: str, content: DataFrame, responses: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """The same for CRM contacts: an update sets status and stage by the score. No site text is moved."""
    narrow = contacts.select(order, "id", "email", "website")
    judged = domain_first_record(narrow, order, content, hot_rows)
    told = _outcome(content, judged, order, F.lit("No domain found"), hot_rows)
    answered = attach(told, lead_analyses(responses).select("email", "analysis"), "email", order, hot_rows=hot_rows)
    score = F.col("analysis.lead_score_adjustment")
    properties = F.create_map(
        F.lit("hs_lead_status"), lead_status(score), F.lit("lifecyclestage"), lifecycle_stage(score)
    )
    return _actions("contacts", answered, properties, F.col("analysis").isNotNull())
