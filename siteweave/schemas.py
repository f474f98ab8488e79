"""Schemas of the tables that cross the engine's boundary, as DDL strings."""

from siteweave.fixed_values import COMPANY_PROPERTIES, CONTACT_PROPERTIES

PAGES = "url string, html string, error string"

SITE_CONTENT = (
    "domain string, url string, success boolean, scraped_at timestamp, "
    "content string, emails array<string>, error string"
)

COMPANY_ANALYSIS = (
    "struct<business_type_description:string, company_summary:string, industry:string, "
    "naics_code:string, company_owner:string, city:string, state_region:string, "
    "postal_code:string, country:string, number_of_employees:string, annual_revenue:string, "
    "timezone:string, target_market:string, primary_products_services:array<string>, "
    "value_propositions:array<string>, competitive_advantages:array<string>, "
    "technologies_used:array<string>, certifications_awards:array<string>, "
    "pain_points_addressed:array<string>, confidence_score:double>"
)

LEAD_ANALYSIS = (
    "struct<buyer_persona:string, lead_score_adjustment:int, confidence:double, reasoning:string>"
)

ENRICHED_COMPANY = (
    "domain string, enriched_at string, success boolean, error string, scraped_url string, "
    f"emails_found array<string>, analysis {COMPANY_ANALYSIS}"
)

ENRICHED_LEADS = (
    "domain string, enriched_at string, success boolean, error string, "
    "leads array<struct<email:string, first_name:string, last_name:string, error:string, "
    f"analysis:{LEAD_ANALYSIS}>>"
)

# Wire form of the analyzer's answer for a company.
COMPANY_RESPONSE = (
    "company struct<name:string, description:string, industry:string, city:string, state:string, "
    "zip:string, country:string, numberofemployees:string, annualrevenue:string>, "
    "business_intelligence struct<business_type_description:string, naics_code:string, "
    "target_market:string, primary_products_services:array<string>, "
    "value_propositions:array<string>, competitive_advantages:array<string>, "
    "technologies_used:array<string>, certifications_awards:array<string>, "
    "pain_points_addressed:array<string>>, "
    "confidence_score double, _error string, _parse_error string"
)

LEAD_RESPONSE = (
    "buyer_persona string, lead_score_adjustment int, confidence double, reasoning string"
)

SCRAPE_METRICS = (
    "domain string, duration double, success boolean, error string, "
    "content_size long, emails_found long"
)


def crm_record(properties: list[str]) -> str:
    """Wire form of a CRM record: an id and a bag of string properties."""
    fields = ", ".join(f"{name}:string" for name in properties)
    return f"id string, properties struct<{fields}>"


CRM_CONTACT = crm_record(CONTACT_PROPERTIES)
CRM_COMPANY = crm_record(COMPANY_PROPERTIES)
