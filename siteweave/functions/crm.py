"""Column functions that build CRM property maps and note texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.fixed_values import (
    BULK_NOTE,
    BULK_PREVIEW,
    COMPANY_IMPORT_PROPERTIES,
    COMPANY_NOTE,
    COMPANY_PREVIEW,
    COMPLETED,
    CONTACT_IMPORT_PROPERTIES,
    DESCRIPTION_LIMIT,
    LEAD_NOTE,
    LEAD_PREVIEW,
    LIST_FIELDS,
    NOTE_FOOTER,
    NOTE_LIMIT,
)
from siteweave.functions.analysis import map_industry, parse_employees, parse_revenue
from siteweave.functions.text import or_empty, percent_1


def _property_map(values: dict[str, Column], always: set[str]) -> Column:
    """Map of the non-empty values; the ``always`` ones are kept even when empty."""
    entries = [v for name, c in values.items() for v in (F.lit(name), or_empty(c.cast("string")))]
    return F.map_filter(F.create_map(*entries), lambda k, v: (v != "") | k.isin(*sorted(always)))


def _cell(records: DataFrame, name: str) -> Column:
    return F.col(name) if name in records.columns else F.lit("")


def import_company_properties(records: DataFrame) -> Column:
    """CRM properties of an import row; the domain doubles as name."""
    values = {
        "domain": _cell(records, "domain"),
        "name": _cell(records, "domain"),
        **{prop: _cell(records, c) for c, prop in COMPANY_IMPORT_PROPERTIES.items()},
        "enrichment_status": F.lit(COMPLETED),
        "enrichment_date": _cell(records, "enriched_at"),
    }
    return _property_map(values, {"domain", "name", "enrichment_status", "enrichment_date"})


def import_contact_properties(records: DataFrame) -> Column:
    values = {
        "email": _cell(records, "email"),
        **{prop: _cell(records, c) for c, prop in CONTACT_IMPORT_PROPERTIES.items()},
        "enrichment_status": F.lit(COMPLETED),
        "enrichment_date": _cell(records, "enriched_at"),
    }
    return _property_map(values, {"email", "enrichment_status", "enrichment_date"})


def company_update_properties(analysis: Column, content: Column, enriched_at: Column) -> Column:
    """Properties sent when a CRM company was analysed; the date is in epoch milliseconds."""
    values = {
        "description": analysis["company_summary"],
        "city": analysis["city"],
        "state": analysis["state_region"],
        "zip": analysis["postal_code"],
        "country": analysis["country"],
        "timezone": analysis["timezone"],
        "site_content": F.substring(content, 1, DESCRIPTION_LIMIT),
        "enrichment_status": F.lit(COMPLETED),
        "enrichment_date": F.unix_millis(enriched_at),
        "industry": map_industry(analysis["industry"]),
        "annualrevenue": parse_revenue(analysis["annual_revenue"]),
        "numberofemployees": parse_employees(analysis["number_of_employees"]),
    }
    return _property_map(values, {"enrichment_status"})


def _fill(layout: str, values: list[Column]) -> Column:
    """Put the values in the places of a layout; a null shows as None."""
    head, *rest = layout.split("%s")
    parts = [F.lit(head)]
    for value, text in zip(values, rest, strict=True):
        parts += [F.coalesce(value.cast("string"), F.lit("None")), F.lit(text)]
    return F.concat(*parts)


def _minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def lead_note(
    lead: dict[str, Column], domain: Column, analysis: Column, content: Column, at: Column,
    footer: str = NOTE_FOOTER,
) -> Column:
    """Note text of an analysed contact. ``lead`` holds firstname, lastname and email."""
    text = _fill(LEAD_NOTE, [
        _minute(at), lead["firstname"], lead["lastname"], lead["email"], domain,
        analysis["buyer_persona"], analysis["lead_score_adjustment"],
        percent_1(analysis["confidence"]), analysis["reasoning"],
        F.substring(or_empty(content), 1, LEAD_PREVIEW), F.lit(footer),
    ])
    return F.substring(text, 1, NOTE_LIMIT)


def company_note(
    name: Column, domain: Column, analysis: Column, content: Column, at: Column,
    footer: str = NOTE_FOOTER,
) -> Column:
    """Note text of an analysed company."""
    plain = [
        "industry", "naics_code", "company_owner", "city", "state_region", "postal_code",
        "country", "timezone", "number_of_employees", "annual_revenue", "company_summary",
        "business_type_description", "target_market",
    ]
    text = _fill(COMPANY_NOTE, [
        _minute(at), name, domain, *[analysis[f] for f in plain],
        *[or_empty(F.array_join(analysis[f], ", ")) for f in LIST_FIELDS],
        percent_1(analysis["confidence_score"]),
        F.substring(or_empty(content), 1, COMPANY_PREVIEW), F.lit(footer),
    ])
    return F.substring(text, 1, NOTE_LIMIT)


def bulk_company_note(content: Column) -> Column:
    """Short note of the bulk run; null without content."""
    return F.when(
        or_empty(content) != "", _fill(BULK_NOTE, [F.substring(content, 1, BULK_PREVIEW)])
    )
