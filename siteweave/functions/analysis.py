"""Column functions on analyzer answers and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siteweave.fixed_values import (
    DEFAULT_CONFIDENCE_POINTS,
    INDUSTRY_CODES,
    LEAD_PROMPT,
    LIST_FIELDS,
    PROMPT_CONTENT_LIMIT,
    REVENUE_UNIT,
)
from siteweave.functions.text import filled, first_number, let, or_empty
from siteweave.schemas import COMPANY_ANALYSIS, COMPANY_RESPONSE, LEAD_RESPONSE


def _flagged(c: Column) -> Column:
    return filled(c) & (c != "false")


def parse_company_response(response: Column) -> Column:
    """Analyzer answer (JSON) for a company as an analysis struct; null when it failed.

    Failed means: no JSON object, or a non-empty ``_error`` or ``_parse_error``. The score of 1 to 10
    becomes 0.1 to 1.0; a missing score counts as 5.
    """
    # bound once: field by field, the optimizer would parse the text again for every field
    data = F.from_json(response, COMPANY_RESPONSE + ", _corrupt_record string")
    is_object = response.rlike(r"(?s)^\s*\{.*\}\s*$")
    return let(data, lambda d: F.when(is_object & _answered(d), _company_fields(d)))


def _answered(data: Column) -> Column:
    # a corrupt text parses to a struct of nulls and shows up only in this column
    failed = _flagged(data["_error"]) | _flagged(data["_parse_error"])
    return data["_corrupt_record"].isNull() & ~failed


def _company_fields(data: Column) -> Column:
    company, insight = data["company"], data["business_intelligence"]
    none = F.lit(None).cast("string")
    score = F.coalesce(data["confidence_score"], F.lit(float(DEFAULT_CONFIDENCE_POINTS))) / F.lit(10.0)
    fields = [
        or_empty(insight["business_type_description"]).alias("business_type_description"),
        or_empty(company["description"]).alias("company_summary"),
        or_empty(company["industry"]).alias("industry"),
        or_empty(insight["naics_code"]).alias("naics_code"),
        none.alias("company_owner"),
        company["city"].alias("city"),
        company["state"].alias("state_region"),
        company["zip"].alias("postal_code"),
        company["country"].alias("country"),
        company["numberofemployees"].alias("number_of_employees"),
        company["annualrevenue"].alias("annual_revenue"),
        none.alias("timezone"),
        or_empty(insight["target_market"]).alias("target_market"),
        *[
            F.coalesce(insight[f], F.expr("cast(array() as array<string>)")).alias(f)
            for f in LIST_FIELDS
        ],
        score.alias("confidence_score"),
    ]
    return F.struct(*fields).cast(COMPANY_ANALYSIS)


def parse_lead_response(response: Column) -> Column:
    """Analyzer answer (text around one JSON object) for a lead; null when a key is missing."""
    outer = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    data = F.from_json(F.when(outer != "", outer).otherwise(response), LEAD_RESPONSE)

    def checked(d: Column) -> Column:
        complete = (
            d["buyer_persona"].isNotNull()
            & d["lead_score_adjustment"].isNotNull()
            & d["confidence"].isNotNull()
            & d["reasoning"].isNotNull()
        )
        return F.when(complete, d)

    return let(data, checked)


def analysis_flat(analysis: Column, separator: str = ", ") -> list[Column]:
    """Fields of a company analysis as columns, the lists joined to text."""
    plain = [
        "business_type_description", "company_summary", "industry", "naics_code", "company_owner",
        "city", "state_region", "postal_code", "country", "number_of_employees",
        "annual_revenue", "timezone", "target_market",
    ]
    return [
        *[analysis[f].alias(f) for f in plain],
        *[or_empty(F.array_join(analysis[f], separator)).alias(f) for f in LIST_FIELDS],
        analysis["confidence_score"].alias("confidence_score"),
    ]


def parse_revenue(c: Column) -> Column:
    """First digit run, read as millions: "$10M-$50M" gives 10000000. Zero counts as unknown."""
    return F.nullif(first_number(c) * F.lit(REVENUE_UNIT), F.lit(0))


def parse_employees(c: Column) -> Column:
    """First digit run: "100-500" gives 100."""
    return first_number(c)


def map_industry(c: Column) -> Column:
    """CRM code of an industry label; null for an unknown one."""
    table = F.create_map(*[F.lit(v) for pair in INDUSTRY_CODES.items() for v in pair])
    return F.try_element_at(table, or_empty(c))


def lead_status(score: Column) -> Column:
    return (
        F.when(score >= 7, "OPEN_DEAL")
        .when(score >= 5, "CONNECTED")
        .when(score >= 0, "OPEN")
        .when(score < 0, "UNQUALIFIED")
    )


def lifecycle_stage(score: Column) -> Column:
    return F.when(score < 5, "lead").when(score >= 5, "marketingqualifiedlead")


def display_name(domain: Column, owner: Column) -> Column:
    named = F.concat(domain, F.lit(" ("), owner, F.lit(")"))
    return F.when(filled(owner), named).otherwise(domain)


def lead_prompt(
    content: Column, firstname: Column, lastname: Column, company: Column, email: Column
) -> Column:
    """Question put to an analyzer about one lead; the site text is cut to 4000 characters."""
    mail_host = F.when(email.contains("@"), F.substring_index(email, "@", -1)).otherwise("Unknown")
    head, *rest = LEAD_PROMPT.split("%s")
    values = [
        or_empty(firstname), or_empty(lastname), or_empty(company), or_empty(email),
        F.coalesce(mail_host, F.lit("Unknown")),
        F.substring(or_empty(content), 1, PROMPT_CONTENT_LIMIT),
    ]
    parts = [F.lit(head)]
    for value, text in zip(values, rest, strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)
