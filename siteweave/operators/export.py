"""Export rows: plain CSV, CRM-format CSV, and unions of differing rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from siteweave.fixed_values import (
    COMPANY_EXPORT_COLUMNS,
    COMPANY_EXPORT_LISTS,
    COMPLETED,
    CRM_COMPANY_COLUMNS,
    CRM_COMPANY_FIELDS,
    CRM_COMPANY_FIRST,
    CRM_LEAD_COLUMNS,
    CRM_LEAD_COMPANY_FIELDS,
    CRM_LEAD_FIRST,
    DESCRIPTION_LIMIT,
    LEAD_EXPORT_COLUMNS,
    LEAD_SOURCE,
    NAME_LIMIT,
    STANDARD_LIMIT,
)
from siteweave.functions.domains import normalize_domain
from siteweave.functions.names import guess_lead_name
from siteweave.functions.text import format_confidence, or_empty, truncate_field
from siteweave.plans.stages import written


def company_export_rows(enriched: DataFrame) -> DataFrame:
    """The 16 export columns per company record; a missing analysis gives empty texts and score 0."""
    a = F.col("analysis")
    lists = {
        out: or_empty(F.concat_ws(";", a[field])) for out, field in COMPANY_EXPORT_LISTS.items()
    }
    columns = {
        "domain": or_empty(F.col("domain")),
        "enriched_at": or_empty(F.col("enriched_at")),
        "success": F.coalesce("success", F.lit(False)),
        "error": or_empty(F.col("error")),
        "scraped_url": or_empty(F.col("scraped_url")),
        "emails_found": or_empty(F.concat_ws(";", "emails_found")),
        "business_type": or_empty(a["business_type_description"]),
        "naics_code": or_empty(a["naics_code"]),
        "target_market": or_empty(a["target_market"]),
        **lists,
        "confidence_score": F.coalesce(a["confidence_score"], F.lit(0.0)),
    }
    return enriched.select(*[columns[c].alias(c) for c in COMPANY_EXPORT_COLUMNS])


def lead_export_rows(enriched: DataFrame) -> DataFrame:
    """The 8 export columns per lead of the stage records."""
    lead = F.col("lead")
    columns = {
        "email": or_empty(lead["email"]),
        "first_name": or_empty(lead["first_name"]),
        "last_name": or_empty(lead["last_name"]),
        "company_domain": or_empty(F.col("domain")),
        "enriched_at": or_empty(F.col("enriched_at")),
        "error": or_empty(lead["error"]),
        "buyer_persona": or_empty(lead["analysis"]["buyer_persona"]),
        "lead_score_adjustment": F.coalesce(lead["analysis"]["lead_score_adjustment"], F.lit(0)),
    }
    exploded = enriched.select("domain", "enriched_at", F.explode("leads").alias("lead"))
    return exploded.select(*[columns[c].alias(c) for c in LEAD_EXPORT_COLUMNS])


def _field(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column of ``df`` as text; the default where the frame has no such column."""
    if name not in df.columns:
        return default if default is not None else F.lit("")
    value = F.col(name).cast("string")
    return F.coalesce(value, default) if default is not None else value


def crm_company_rows(results: DataFrame) -> DataFrame:
    """Results per domain as CRM company rows, every column of the fixed header present."""
    domain = normalize_domain(F.col("domain"))
    columns = {
        "Company Domain Name": domain,
        "Name": truncate_field(_field(results, "name", domain), NAME_LIMIT),
        **{
            header: truncate_field(_field(results, field), limit)
            for header, (field, limit) in CRM_COMPANY_FIELDS.items()
        },
        "Confidence Score": format_confidence(_field(results, "confidence_score")),
        "Enrichment Status": _field(results, "enrichment_status", F.lit(COMPLETED)),
        "Site Content": truncate_field(_field(results, "site_content"), DESCRIPTION_LIMIT),
        "Enrichment Error": truncate_field(_field(results, "enrichment_error"), STANDARD_LIMIT),
    }
    return results.select(*[columns[c].alias(c) for c in CRM_COMPANY_COLUMNS])


def crm_lead_rows(leads: DataFrame) -> DataFrame:
    """Leads ``(email, domain, …)`` as CRM contact rows, every column of the fixed header present.

    Names are guessed from the address only when neither name is given.
    """
    email = normalize_domain(F.col("email"))
    first, last = _field(leads, "firstname"), _field(leads, "lastname")
    unnamed = (or_empty(first) == "") & (or_empty(last) == "")
    guess = guess_lead_name(email)
    columns = {
        "Email": email,
        "First Name": truncate_field(F.when(unnamed, guess["firstname"]).otherwise(first), NAME_LIMIT),
        "Last Name": truncate_field(F.when(unnamed, guess["lastname"]).otherwise(last), NAME_LIMIT),
        "Company Name": truncate_field(_field(leads, "company", F.col("domain")), STANDARD_LIMIT),
        "Website URL": F.concat(F.lit("https://"), "domain"),
        "Lead Status": F.lit("New"),
        "Lifecycle Stage": F.lit("Lead"),
        "Lead Source": truncate_field(_field(leads, "lead_source", F.lit(LEAD_SOURCE)), STANDARD_LIMIT),
        "Buyer Persona": truncate_field(_field(leads, "buyer_persona"), STANDARD_LIMIT),
        "Lead Score Adjustment": _field(leads, "lead_score_adjustment", F.lit("0")),
        "Company Domain": F.col("domain"),
        **{
            header: truncate_field(_field(leads, field), STANDARD_LIMIT)
            for header, field in CRM_LEAD_COMPANY_FIELDS.items()
        },
        "Enrichment Status": _field(leads, "enrichment_status", F.lit(COMPLETED)),
        "Enrichment Date": or_empty(_field(leads, "enrichment_date")),
    }
    empty = F.lit("")
    return leads.select(*[columns.get(c, empty).alias(c) for c in CRM_LEAD_COLUMNS])


def _written_with_flags(rows: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Rows written as a table, and per column whether any value was not empty, seen during the write."""
    seen = Observation()
    flags = [F.max(or_empty(F.col(f"`{c}`")) != "").alias(f"f{i}") for i, c in enumerate(rows.columns)]
    table = written(rows.observe(seen, *flags), name)
    return table, {c: seen.get[f"f{i}"] for i, c in enumerate(rows.columns)}


def used_columns(flags: dict, first: list[str], keep: list[str]) -> list[str]:
    """Columns with any non-empty value, the ``first`` ones in front and the rest sorted.

    ``flags`` tells for each column whether it has one, or null when there were no rows.
    """
    used = [c for c, flag in flags.items() if flag or (c in keep and flag is not None)]
    return [c for c in first if c in used] + sorted(c for c in used if c not in first)


def crm_company_csv(results: DataFrame) -> DataFrame:
    """CRM company CSV with only the used columns.

    The rows are computed and written once, which also tells the used columns; the export reads those.
    """
    rows, flags = _written_with_flags(crm_company_rows(results), "crm-company-rows")
    return rows.select(*[F.col(f"`{c}`") for c in used_columns(flags, CRM_COMPANY_FIRST, ["Enrichment Status"])])


def crm_lead_csv(leads: DataFrame) -> DataFrame:
    """CRM contact CSV with only the used columns."""
    rows, flags = _written_with_flags(crm_lead_rows(leads), "crm-lead-rows")
    return rows.select(*[F.col(f"`{c}`") for c in used_columns(flags, CRM_LEAD_FIRST, ["Email", "Enrichment Status"])])


def union_exports(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with differing columns; a missing value is an empty text."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.fillna("")
