"""Queries on analyses, enrichment joins and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteweave import schemas
from siteweave.catalog import roles, sql
from siteweave.fixed_values import (
    COMPANY_EXPORT_LISTS,
    COMPANY_NOTE,
    COMPANY_PREVIEW,
    CRM_COMPANY_COLUMNS,
    CRM_COMPANY_FIELDS,
    CRM_LEAD_COLUMNS,
    CRM_LEAD_COMPANY_FIELDS,
    DESCRIPTION_LIMIT,
    INDUSTRY_CODES,
    LEAD_COMPANY_ATTRIBUTES,
    LEAD_NOTE,
    LEAD_PREVIEW,
    LIST_FIELDS,
    NOTE_FOOTER,
)
from siteweave.functions import analysis as an, crm as crm_fn, names, text
from siteweave.operators import crm, enrich, export, reports, updates
from siteweave.plans.stages import fresh_path
from siteweave.sources import tables

# --- what the analyzer answers of the companies role parse to, in SQL -----------------------

_PARSED = {
    "business_type_description": "coalesce(business_type_description, '')",
    "company_summary": "coalesce(description, '')",
    "industry": "coalesce(industry, '')",
    "naics_code": "coalesce(naics_code, '')",
    "company_owner": "cast(null as varchar)",
    "city": "city",
    "state_region": "state",
    "postal_code": "cast(null as varchar)",
    "country": "country",
    "number_of_employees": "numberofemployees",
    "annual_revenue": "annualrevenue",
    "timezone": "cast(null as varchar)",
    "target_market": "coalesce(target_market, '')",
    "primary_products_services": "['one', coalesce(state, 'two')]",
    "value_propositions": "cast([] as varchar[])",
    "competitive_advantages": "cast([] as varchar[])",
    "technologies_used": "[coalesce(name, 'none')]",
    "certifications_awards": "cast([] as varchar[])",
    "pain_points_addressed": "cast([] as varchar[])",
    "confidence_score": "case when n % 7 = 0 then 0.5::double else (n % 10 + 1) / 10.0::double end",
}
_ANALYSES = (
    "analyses as (select n, 'c' || n || '.example.com' as host, "
    "not (n % 19 = 7 or n % 23 = 8) as answered, "
    + ", ".join(f"{e} as a_{f}" for f, e in _PARSED.items())
    + " from companies)"
)
_ANALYSED = [roles.COMPANIES_SQL, _ANALYSES]


def _flat_sql(separator: str = ", ") -> str:
    return ", ".join(
        f"case when answered then array_to_string(a_{f}, '{separator}') else '' end as {f}"
        if f in LIST_FIELDS
        else f"case when answered then a_{f} end as {f}"
        for f in _PARSED
    )


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.company_analyses(roles.company_responses(spark, sf))


def parse_company_response(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _analyses(spark, sf)
    a = F.col("analysis")
    return parsed.select("domain", a.isNotNull().alias("answered"), *an.analysis_flat(a))


def analysis_flat(spark: SparkSession, sf: str) -> DataFrame:
    return _analyses(spark, sf).select("domain", *an.analysis_flat(F.col("analysis"), ";"))


def parse_lead_response(spark: SparkSession, sf: str) -> DataFrame:
    parsed = enrich.lead_analyses(roles.lead_responses(spark, sf))
    return parsed.select("email", "analysis.*")


def _company_column(name: str, fn) -> callable:
    return lambda spark, sf: roles.companies(spark, sf).select("id", fn().alias(name))


def parse_employees(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "part").select(
        "p_partkey",
        an.parse_employees(F.expr("p_name || ' ' || cast(p_size as string) || '-500'")).alias("employees"),
    )


def parse_revenue(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.expr("case when p_size % 5 = 0 then p_name else '$' || cast(p_size - 1 as string) || 'M-$90M' end")
    return roles.table(spark, sf, "part").select("p_partkey", an.parse_revenue(shown).alias("revenue"))


def format_confidence(spark: SparkSession, sf: str) -> DataFrame:
    score = F.expr("case when p_size = 1 then 0.0 when p_size = 2 then null else p_retailprice / 7000 end")
    return roles.table(spark, sf, "part").select(
        "p_partkey",
        text.format_confidence(score).alias("from_number"),
        text.format_confidence(F.col("p_name")).alias("from_text"),
    )


def lead_status(spark: SparkSession, sf: str) -> DataFrame:
    score = F.floor(F.col("c_acctbal") / 1000).cast("int")
    return roles.table(spark, sf, "customer").select(
        "c_custkey", an.lead_status(score).alias("status"), an.lifecycle_stage(score).alias("stage")
    )


def company_display_name(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.companies(spark, sf)
    return c.select("id", an.display_name(F.col("domain"), F.col("city")).alias("display_name"))


# --- enrichment ------------------------------------------------------------------------------


def _enriched_companies(spark: SparkSession, sf: str) -> DataFrame:
    content = roles.doc_content(spark, sf)
    analyzer = enrich.from_responses(roles.company_responses(spark, sf))
    return enrich.enrich_company(content, analyzer, F.lit(roles.STAMP))


_CONTENT = (
    "content as (select n, domain, url, length(text) > 100 as success, "
    "case when length(text) > 100 then text else '' end as content, "
    f"{sql.emails('text', chr(39) + 'example.com' + chr(39))} as emails, "
    "case when n % 2 = 0 and length(text) <= 100 then 'Insufficient content scraped (only ' || "
    "length(text) || ' characters)' end as error from docs)"
)
_ENRICHED = (
    f"enriched as (select c.*, coalesce(a.answered and c.success, false) as done, a.* exclude (n) "
    "from content c left join analyses a on c.domain = a.host)"
)
_ENRICH = [roles.DOCS_SQL, _CONTENT, *_ANALYSED, _ENRICHED]


def enrich_company(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched_companies(spark, sf).select(
        "domain", "enriched_at", "success", "error", "scraped_url",
        F.array_join("emails_found", " ").alias("emails_found"),
        F.col("analysis").isNotNull().alias("analysed"),
        F.col("analysis.industry").alias("industry"),
        F.col("analysis.confidence_score").alias("confidence_score"),
    )


def company_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "enriched-companies")
    tables.write_stage(_enriched_companies(spark, sf), path)
    return export.company_export_rows(tables.read_enriched_companies(spark, path))


_EXPORT_SQL = (
    f"select domain, '{roles.STAMP}' as enriched_at, success, "
    "case when success then '' else 'Scraping failed: ' || coalesce(error, 'Unknown error') end as error, "
    "case when success then url else '' end as scraped_url, "
    "case when success then array_to_string(emails, ';') else '' end as emails_found, "
    "case when done then a_business_type_description else '' end as business_type, "
    "case when done then a_naics_code else '' end as naics_code, "
    "case when done then a_target_market else '' end as target_market, "
    + ", ".join(
        f"case when done then array_to_string(a_{f}, ';') else '' end as {c}"
        for c, f in COMPANY_EXPORT_LISTS.items()
    )
    + ", case when done then a_confidence_score else 0.0::double end as confidence_score from enriched"
)


def _enriched_leads(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_leads(
        roles.site_content(spark, sf), roles.lead_responses(spark, sf), F.lit(roles.STAMP)
    )


def enrich_leads(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform(
        "leads",
        lambda x: F.concat_ws(
            "/", x["email"], x["first_name"], x["last_name"],
            F.coalesce(x["analysis"]["buyer_persona"], F.lit("-")),
        ),
    )
    return _enriched_leads(spark, sf).select(
        "domain", "enriched_at", "success", F.size("leads").alias("n_leads"),
        F.array_join(shown, " ").alias("leads"),
    )


def lead_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "enriched-leads")
    tables.write_stage(_enriched_leads(spark, sf), path)
    return export.lead_export_rows(tables.read_enriched_leads(spark, path))


_LEADS = (
    "leads as (select n, domain, site, email, "
    f"{sql.title('''string_split(string_split(email, '@')[1], '.')[1]''')} as first_name, "
    f"{sql.title('''string_split(string_split(email, '@')[1], '.')[-1]''')} as last_name, "
    "site % 5 <> 3 and n % 9 <> 1 as answered, persona, score, name from members where site % 7 <> 2)"
)
_LEAD = [roles.MEMBERS_SQL, _LEADS]


def parse_email_name(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.contacts(spark, sf)
    return c.select("id", names.parse_email_name(F.col("email")).alias("n")).select("id", "n.*")


def guess_lead_name(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.contacts(spark, sf)
    return c.select("id", names.guess_lead_name(F.col("email")).alias("n")).select("id", "n.*")


_LOCAL = "string_split(email, '@')[1]"
_WORDS = f"list_filter(string_split(translate({_LOCAL}, '._-', '   '), ' '), lambda w: w <> '')"


# --- CRM-format exports ------------------------------------------------------------------------


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.domain_results(roles.doc_content(spark, sf), _analyses(spark, sf))


_RESULT_FIELDS = {
    f: (
        f"case when answered then array_to_string(a_{f}, ', ') else '' end"
        if f in LIST_FIELDS
        else f"case when answered then cast(a_{f} as varchar) end"
    )
    for f in _PARSED
}
_RESULT_ERROR = (
    "case when not success then coalesce(error, 'Scraping failed') "
    "when not done then 'Analysis failed' end"
)
_CRM_COMPANY = {
    "Company Domain Name": "domain",
    "Name": "domain",
    **{h: sql.truncate(_RESULT_FIELDS[f], n) for h, (f, n) in CRM_COMPANY_FIELDS.items()},
    "Confidence Score": sql.confidence(_RESULT_FIELDS["confidence_score"]),
    "Enrichment Status": "case when done then 'completed' else 'failed' end",
    "Site Content": sql.truncate("case when success then content end", 65536),
    "Enrichment Error": sql.truncate(_RESULT_ERROR, 255),
}
# columns that no result fills: never known to the analyzer, or empty in every answer of the role
_NEVER_FILLED = [
    "Postal Code", "Timezone", "Value Propositions", "Competitive Advantages",
    "Certifications Awards", "Pain Points Addressed",
]


def _named(columns: dict[str, str], names_: list[str]) -> str:
    return ", ".join(f'{columns[c]} as "{c}"' for c in names_)


def crm_company_csv(spark: SparkSession, sf: str) -> DataFrame:
    return export.crm_company_csv(_results(spark, sf))


def crm_company_csv_fixed(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "crm-companies")
    tables.write_csv(export.crm_company_rows(_results(spark, sf)), path, mode="append")
    return tables.read_csv(spark, path).fillna("")


def lead_company_attributes(spark: SparkSession, sf: str) -> DataFrame:
    leads = roles.contacts(spark, sf).select("n", "email", F.col("company").alias("domain"))
    companies = roles.companies(spark, sf).select(
        "domain", "name", "industry", "city", F.col("state").alias("state_region"), "country",
        F.col("numberofemployees").alias("number_of_employees"),
        F.col("annualrevenue").alias("annual_revenue"),
    ).where(F.col("domain").isNotNull())
    return enrich.lead_company_attributes(leads, companies)


_ATTRIBUTES_SQL = (
    "select l.n, l.email, l.company as domain, coalesce(c.name, l.company) as company, "
    "coalesce(c.industry, '') as company_industry, coalesce(c.city, '') as company_city, "
    "coalesce(c.state, '') as company_state, coalesce(c.country, '') as company_country, "
    "coalesce(c.numberofemployees, '') as company_employees, "
    "coalesce(c.annualrevenue, '') as company_revenue "
    "from contacts l left join (select * from companies where domain like 'c%') c on l.company = c.domain"
)


def crm_lead_csv(spark: SparkSession, sf: str) -> DataFrame:
    leads = lead_company_attributes(spark, sf).withColumn("enrichment_date", F.lit(roles.STAMP))
    return export.crm_lead_csv(leads)


def crm_lead_csv_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts with known names and scores, in the fixed columns of the appended file."""
    leads = roles.contacts(spark, sf).select(
        "email", F.col("company").alias("domain"), "firstname", "lastname", "buyer_persona",
        "lead_score_adjustment",
    )
    return export.crm_lead_rows(leads)


_GUESSED = {
    "firstname": sql.title(f"coalesce({_WORDS}[1], '')"),
    "lastname": sql.title(f"coalesce(array_to_string({_WORDS}[2:], ' '), '')"),
}
_CRM_LEAD = {
    "Email": "email",
    "First Name": _GUESSED["firstname"],
    "Last Name": _GUESSED["lastname"],
    "Company Name": "company",
    "Lead Source": "'Website Scraping'",
    **{h: f for h, f in CRM_LEAD_COMPANY_FIELDS.items()},
    "Enrichment Status": "'completed'",
    "Enrichment Date": f"'{roles.STAMP}'",
    "Website URL": "'https://' || domain",
    "Lead Status": "'New'",
    "Lifecycle Stage": "'Lead'",
    "Lead Score Adjustment": "'0'",
    "Company Domain": "domain",
}


def union_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Company and contact records in one table with the union of their columns."""
    c = roles.companies(spark, sf).select("id", "name", "domain", "industry")
    p = roles.contacts(spark, sf).select("id", "email", "company")
    return export.union_exports([c, p])


def export_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    done = results.where(F.col("enrichment_status") == "completed").select(
        "domain", "name", "enrichment_status", "industry", "confidence_score"
    )
    errors = results.where(F.col("enrichment_status") == "failed").select(
        "domain", F.concat(F.lit("failed after: "), "enrichment_error").alias("error")
    )
    rows = export.crm_company_rows(
        done.withColumn("confidence_score", F.col("confidence_score").cast("string")).unionByName(
            enrich.failed_export_rows(errors), allowMissingColumns=True
        )
    )
    return rows.select(
        "`Company Domain Name`", "Name", "Industry", "`Confidence Score`", "`Enrichment Status`",
        "`Enrichment Error`",
    )


def export_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.export_counts(
        export.company_export_rows(_enriched_companies(spark, sf)),
        export.lead_export_rows(_enriched_leads(spark, sf)),
    )


def _plugin(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in analyzer: describes a site by the length of its text."""
    answer = batch["content"].str.len().map(
        lambda n: f'{{"company": {{"description": "{n} characters"}}, "confidence_score": 7}}'
    )
    return pd.DataFrame({"domain": batch["domain"], "response_text": answer})


def analyze_with_plugin(spark: SparkSession, sf: str) -> DataFrame:
    enriched = enrich.enrich_company(
        roles.doc_content(spark, sf), enrich.from_batches(_plugin), F.lit(roles.STAMP)
    )
    return enriched.select(
        "domain", "success", F.col("analysis.company_summary").alias("summary"),
        F.col("analysis.confidence_score").alias("confidence_score"),
    )


# --- CRM updates, notes, bulk ------------------------------------------------------------------


def _property_text(c: Column) -> Column:
    pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def _analysed_content(spark: SparkSession, sf: str, limit: int = DESCRIPTION_LIMIT) -> DataFrame:
    """Analysed sites; their text is cut to what is used before the join moves it."""
    content = roles.doc_content(spark, sf).where("success").withColumn("content", F.substring("content", 1, limit))
    return content.join(_analyses(spark, sf).where(F.col("analysis").isNotNull()), "domain")


def company_update_properties(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.to_timestamp(F.lit(roles.STAMP))
    props = crm_fn.company_update_properties(F.col("analysis"), F.col("content"), stamp)
    return _analysed_content(spark, sf).select("domain", _property_text(props).alias("properties"))


def _first_digits(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '[0-9]+'), '') as bigint)"


_UPDATE = {
    "description": "a_company_summary", "city": "a_city", "state": "a_state_region",
    "country": "a_country", "site_content": "left(content, 65536)",
    "enrichment_status": "'completed'", "enrichment_date": "'1704110400000'",
    "industry": "case a_industry "
    + " ".join(f"when '{k}' then '{v}'" for k, v in INDUSTRY_CODES.items()) + " else '' end",
    "annualrevenue": f"cast(nullif({_first_digits('a_annual_revenue')} * 1000000, 0) as varchar)",
    "numberofemployees": f"cast({_first_digits('a_number_of_employees')} as varchar)",
}


def company_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _analysed_content(spark, sf, COMPANY_PREVIEW).withColumn("id", F.col("n").cast("string"))
    body = crm_fn.company_note(
        F.concat(F.lit("Company "), "id"), F.col("domain"), F.col("analysis"), F.col("content"),
        F.to_timestamp(F.lit(roles.STAMP)),
    )
    return crm.notes("companies", rows, body)


def bulk_company_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.doc_content(spark, sf).withColumn("id", F.col("n").cast("string"))
    return crm.notes("companies", rows, crm_fn.bulk_company_note(F.col("content")))


def lead_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.lead_rows(roles.site_content(spark, sf), roles.lead_responses(spark, sf))
    content = roles.site_content(spark, sf).select("domain", F.substring("content", 1, LEAD_PREVIEW).alias("content"))
    noted = rows.where(F.col("analysis").isNotNull()).join(content, "domain").withColumn(
        "id", F.col("email")
    )
    lead = {"firstname": F.col("first_name"), "lastname": F.col("last_name"), "email": F.col("email")}
    body = crm_fn.lead_note(
        lead, F.col("domain"), F.col("analysis"), F.col("content"),
        F.to_timestamp(F.lit(roles.STAMP)),
    )
    return crm.notes("contacts", noted, body)


def _fill_sql(layout: str, values: list[str]) -> str:
    out = "'" + layout.replace("'", "''") + "'"
    for value in values:
        out = out.replace("%s", f"' || coalesce({value}, 'None') || '", 1)
    return out


def _percent(x: str) -> str:
    return f"printf('%.1f%%', coalesce({x}, 0) * 100)"


_COMPANY_NOTE_SQL = _fill_sql(COMPANY_NOTE, [
    "'2024-01-01 12:00'", "'Company ' || n", "domain",
    *[f"a_{f}" for f in (
        "industry", "naics_code", "company_owner", "city", "state_region", "postal_code", "country",
        "timezone", "number_of_employees", "annual_revenue", "company_summary",
        "business_type_description", "target_market",
    )],
    *[f"array_to_string(a_{f}, ', ')" for f in LIST_FIELDS],
    _percent("a_confidence_score"), "left(content, 1000)", f"'{NOTE_FOOTER}'",
])
_SITE_TEXT = (
    "sites as (select domain, string_agg(name, ' and ' order by n) as content from members group by domain)"
)
_LEAD_NOTE_SQL = _fill_sql(LEAD_NOTE, [
    "'2024-01-01 12:00'", "first_name", "last_name", "email", "domain", "persona",
    "cast(score as varchar)", "'50.0%'", "l.name", "left(content, 2000)", f"'{NOTE_FOOTER}'",
])


def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.bulk_companies(roles.companies(spark, sf).drop("n"), _results(spark, sf))


def bulk_results(spark: SparkSession, sf: str) -> DataFrame:
    done = enrich.bulk_results(_bulk(spark, sf))
    return done.select(
        "id", "domain", "enrichment_status", "enrichment_error", "industry",
        F.length("site_content").alias("content_chars"),
        F.get_json_object("original_data", "$.name").alias("original_name"),
    )


def bulk_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = enrich.bulk_errors(_bulk(spark, sf))
    return failed.select(
        F.get_json_object("item", "$.id").alias("id"),
        F.substring_index("error", ":", 1).alias("error"),
        "type",
    )


def _members_as_contacts(spark: SparkSession, sf: str) -> DataFrame:
    m = roles.members(spark, sf)
    email = F.when(F.col("n") % 13 == 0, None).when(F.col("n") % 13 == 1, "nobody").otherwise(F.col("email"))
    return m.select(F.col("n").cast("string").alias("id"), email.alias("email"))


def _bulk_leads(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.bulk_leads(
        _members_as_contacts(spark, sf), roles.site_content(spark, sf), roles.lead_responses(spark, sf)
    )


def bulk_lead_results(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.bulk_results(_bulk_leads(spark, sf)).drop("original_data")


def bulk_lead_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = enrich.bulk_errors(_bulk_leads(spark, sf))
    return failed.select(
        F.get_json_object("item", "$.id").alias("id"),
        F.regexp_replace("error", r"missing email: .*", "missing email").alias("error"),
        "type",
    )


def bulk_company_updates(spark: SparkSession, sf: str) -> DataFrame:
    sent = updates.bulk_company_updates(_bulk(spark, sf))
    return sent.withColumn("properties", _property_text(F.map_filter("properties", lambda k, v: v != "")))


def bulk_lead_updates(spark: SparkSession, sf: str) -> DataFrame:
    sent = updates.bulk_lead_updates(_bulk_leads(spark, sf))
    return sent.withColumn("properties", _property_text(F.col("properties")))


def crm_company_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the CRM companies and the sites of the documents."""
    sent = updates.company_enrichment(
        roles.companies(spark, sf), "n", roles.doc_content(spark, sf), _analyses(spark, sf), F.to_timestamp(F.lit(roles.STAMP))
    )
    return sent.withColumn("properties", _property_text(F.col("properties")))


def _run_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The members of the sites, some without an address or with one that has no domain."""
    return _members_as_contacts(spark, sf).select(
        F.col("id").cast("long").alias("n"), "id", "email", F.lit(None).cast("string").alias("website")
    )


def crm_lead_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    sent = updates.lead_enrichment(
        _run_contacts(spark, sf), "n", roles.site_content(spark, sf), roles.lead_responses(spark, sf)
    )
    return sent.withColumn("properties", _property_text(F.col("properties")))


_SENT = {
    "domain": "c.domain",
    "name": "case when e.n is not null then c.domain end",
    **{f: f"case when e.n is not null then {x.replace('answered', 'e.answered').replace('a_', 'e.a_')} end" for f, x in _RESULT_FIELDS.items()},
    "site_content": "case when e.success then e.content end",
    "enrichment_status": "case when e.done then 'completed' when e.n is not null then 'failed' end",
    "enrichment_error": "case when e.n is not null then "
    + _RESULT_ERROR.replace("success", "e.success").replace("error,", "e.error,").replace("not done", "not e.done") + " end",
}
_RUN_COMPANY = (
    "run as (select id, n, case when coalesce(domain, '') <> '' then domain when coalesce(website, '') <> '' "
    f"then {sql.extract_domain('website')} end as domain from companies), "
    "judged as (select r.id, r.domain, e.success, e.error, e.done, e.content, row_number() over (partition by r.domain order by r.n) as place, "
    + ", ".join(f"e.a_{f}" for f in _PARSED)
    + " from run r left join enriched e on e.domain = r.domain), "
    "states as (select *, case when coalesce(domain, '') = '' or length(domain) < 4 or not contains(domain, '.') then 'no_domain' "
    "when not coalesce(success, false) then 'scrape_failed' when place > 1 then 'already_processed' "
    "when done then 'completed' else 'analysis_failed' end as state from judged)"
)
_RUN_LEAD = (
    "judged as (select m.*, row_number() over (partition by site order by n) as place "
    "from (select *, case when n % 13 = 0 then null when n % 13 = 1 then 'nobody' else email end as address from members) m "
    "where address like '%@%'), "
    "states as (select n, case when site % 5 = 3 then 'scrape_failed' when place > 1 then 'already_processed' "
    "when n % 9 = 1 then 'analysis_failed' else 'completed' end as state, score from judged "
    "union all select n, 'no_domain', null from members where n % 13 in (0, 1))"
)
_LEAD_UPDATE = {
    "hs_lead_status": "case when score >= 7 then 'OPEN_DEAL' when score >= 5 then 'CONNECTED' when score >= 0 then 'OPEN' else 'UNQUALIFIED' end",
    "lifecyclestage": "case when score < 5 then 'lead' else 'marketingqualifiedlead' end",
}


_BULK_LEADS = [
    roles.MEMBERS_SQL,
    _SITE_TEXT,
    "asked as (select cast(n as varchar) as id, n, site, domain, persona, score, case when n % 13 = 0 then null "
    "when n % 13 = 1 then 'nobody' else email end as email from members)",
    "judged as (select *, case when email is null then 'Lead missing email' "
    "when email = 'nobody' then 'Could not extract domain from email: nobody' "
    "when site % 5 = 3 then 'Failed to scrape ' || domain || ': timeout' "
    "when n % 9 = 1 then 'Failed to analyze content for ' || email end as error from asked)",
]


def _checked(record: dict) -> dict:
    """A plugged-in record function that refuses some records."""
    if not record["domain"] or "." not in record["domain"]:
        raise ValueError(f"bad domain: {record['domain']}")
    return {"upper": record["domain"].upper()}


def apply_function(spark: SparkSession, sf: str) -> DataFrame:
    asked = roles.companies(spark, sf).select("id", "domain").fillna("")
    out = enrich.apply_to_batches(asked, _checked, "upper string")
    return out.select(F.get_json_object("item", "$.id").alias("id"), "upper", "error", "type")


QUERIES = {
    "parse_company_response": (
        parse_company_response,
        sql.with_(_ANALYSED, f"select host as domain, answered, {_flat_sql()} from analyses"),
    ),
    "analysis_flat": (
        analysis_flat,
        sql.with_(_ANALYSED, f"select host as domain, {_flat_sql(';')} from analyses"),
    ),
    "parse_lead_response": (
        parse_lead_response,
        sql.with_(
            [roles.MEMBERS_SQL],
            "select email, case when n % 9 <> 1 then persona end as buyer_persona, "
            "case when n % 9 <> 1 then score end as lead_score_adjustment, "
            "case when n % 9 <> 1 then 0.5::double end as confidence, "
            "case when n % 9 <> 1 then name end as reasoning from members",
        ),
    ),
    "parse_employees": (
        parse_employees, "select p_partkey, cast(p_size as bigint) as employees from part"
    ),
    "parse_revenue": (
        parse_revenue,
        "select p_partkey, case when p_size % 5 > 0 and p_size > 1 then cast(p_size - 1 as bigint) * 1000000 end "
        "as revenue from part",
    ),
    "map_industry": (
        _company_column("code", lambda: an.map_industry(F.col("industry"))),
        sql.with_(
            [roles.COMPANIES_SQL],
            "select id, case industry "
            + " ".join(f"when '{k}' then '{v}'" for k, v in INDUSTRY_CODES.items())
            + " end as code from companies",
        ),
    ),
    "format_confidence": (
        format_confidence,
        "select p_partkey, "
        + sql.confidence("case when p_size = 1 then 0.0 when p_size > 2 then p_retailprice / 7000 end")
        + " as from_number, '' as from_text from part",
    ),
    "lead_status": (
        lead_status,
        "select c_custkey, case when floor(c_acctbal / 1000) >= 7 then 'OPEN_DEAL' "
        "when floor(c_acctbal / 1000) >= 5 then 'CONNECTED' when floor(c_acctbal / 1000) >= 0 then 'OPEN' "
        "else 'UNQUALIFIED' end as status, case when floor(c_acctbal / 1000) < 5 then 'lead' "
        "else 'marketingqualifiedlead' end as stage from customer",
    ),
    "company_display_name": (
        company_display_name,
        sql.with_(
            [roles.COMPANIES_SQL],
            "select id, case when coalesce(city, '') <> '' then domain || ' (' || city || ')' else domain end "
            "as display_name from companies",
        ),
    ),
    "enrich_company": (
        enrich_company,
        sql.with_(
            _ENRICH,
            f"select domain, '{roles.STAMP}' as enriched_at, success, case when not success then "
            "'Scraping failed: ' || coalesce(error, 'Unknown error') end as error, "
            "case when success then url end as scraped_url, "
            "case when success then array_to_string(emails, ' ') end as emails_found, done as analysed, "
            "case when done then a_industry end as industry, "
            "case when done then a_confidence_score end as confidence_score from enriched",
        ),
    ),
    "company_export_rows": (company_export_rows, sql.with_(_ENRICH, _EXPORT_SQL)),
    "enrich_leads": (
        enrich_leads,
        sql.with_(
            _LEAD,
            f"select m.domain, '{roles.STAMP}' as enriched_at, true as success, "
            "cast(count(l.n) as integer) as n_leads, "
            "coalesce(string_agg(l.email || '/' || first_name || '/' || last_name || '/' || "
            "case when answered then l.persona else '-' end, ' ' order by l.n), '') as leads "
            "from members m left join leads l using (n) group by m.domain",
        ),
    ),
    "lead_export_rows": (
        lead_export_rows,
        sql.with_(
            _LEAD,
            f"select email, first_name, last_name, domain as company_domain, '{roles.STAMP}' as enriched_at, "
            "'' as error, case when answered then persona else '' end as buyer_persona, "
            "case when answered then score else 0 end as lead_score_adjustment from leads",
        ),
    ),
    "parse_email_name": (
        parse_email_name,
        sql.with_(
            [roles.CONTACTS_SQL],
            f"select id, {sql.title(f'''string_split({_LOCAL}, '.')[1]''')} as first_name, "
            f"{sql.title(f'''string_split({_LOCAL}, '.')[-1]''')} as last_name from contacts",
        ),
    ),
    "guess_lead_name": (
        guess_lead_name,
        sql.with_(
            [roles.CONTACTS_SQL],
            f"select id, {_GUESSED['firstname']} as firstname, {_GUESSED['lastname']} as lastname "
            "from contacts",
        ),
    ),
    "crm_company_csv": (
        crm_company_csv,
        sql.with_(
            _ENRICH,
            "select "
            + _named(_CRM_COMPANY, [c for c in CRM_COMPANY_COLUMNS if c not in _NEVER_FILLED])
            + " from enriched",
        ),
    ),
    "crm_company_csv_fixed": (
        crm_company_csv_fixed,
        sql.with_(_ENRICH, f"select {_named(_CRM_COMPANY, CRM_COMPANY_COLUMNS)} from enriched"),
    ),
    "lead_company_attributes": (
        lead_company_attributes,
        sql.with_([roles.CONTACTS_SQL, roles.COMPANIES_SQL], _ATTRIBUTES_SQL),
    ),
    "crm_lead_csv": (
        crm_lead_csv,
        sql.with_(
            [roles.CONTACTS_SQL, roles.COMPANIES_SQL, f"leads as ({_ATTRIBUTES_SQL})"],
            f"select {_named(_CRM_LEAD, list(_CRM_LEAD))} from leads",
        ),
    ),
    "crm_lead_csv_fixed": (
        crm_lead_csv_fixed,
        sql.with_(
            [roles.CONTACTS_SQL, "leads as (select *, company as domain from contacts)"],
            "select "
            + _named(
                {
                    **{c: "''" for c in CRM_LEAD_COLUMNS},
                    **{c: e for c, e in _CRM_LEAD.items() if c not in CRM_LEAD_COMPANY_FIELDS},
                    "Enrichment Date": "''",
                    "First Name": f"case when firstname is null then {_GUESSED['firstname']} else firstname end",
                    "Last Name": f"case when firstname is null then {_GUESSED['lastname']} else coalesce(lastname, '') end",
                    "Buyer Persona": "buyer_persona",
                    "Lead Score Adjustment": "lead_score_adjustment",
                },
                CRM_LEAD_COLUMNS,
            )
            + " from leads",
        ),
    ),
    "union_exports": (
        union_exports,
        sql.with_(
            [roles.CONTACTS_SQL, roles.COMPANIES_SQL],
            "select id, coalesce(name, '') as name, coalesce(domain, '') as domain, "
            "coalesce(industry, '') as industry, '' as email, '' as company from companies union all "
            "select id, '', '', '', coalesce(email, ''), company from contacts",
        ),
    ),
    "export_with_errors": (
        export_with_errors,
        sql.with_(
            _ENRICH,
            'select domain as "Company Domain Name", domain as "Name", '
            "case when done then a_industry else '' end as \"Industry\", "
            f"case when done then {sql.confidence('a_confidence_score')} else '' end as \"Confidence Score\", "
            "case when done then 'completed' else 'failed' end as \"Enrichment Status\", "
            f"coalesce(left('failed after: ' || {_RESULT_ERROR}, 255), '') as \"Enrichment Error\" from enriched",
        ),
    ),
    "export_counts": (
        export_counts,
        sql.with_(
            _LEAD,
            "select (select count(*) from documents) as companies_written, "
            "(select count(*) from leads) as leads_written",
        ),
    ),
    "analyze_with_plugin": (
        analyze_with_plugin,
        sql.with_(
            [roles.DOCS_SQL],
            "select domain, length(text) > 100 as success, "
            "case when length(text) > 100 then length(text) || ' characters' end as summary, "
            "case when length(text) > 100 then 0.7::double end as confidence_score from docs",
        ),
    ),
    "company_update_properties": (
        company_update_properties,
        sql.with_(
            _ENRICH,
            f"select domain, {sql.properties(_UPDATE, ('enrichment_status',))} as properties "
            "from enriched where done",
        ),
    ),
    "company_notes": (
        company_notes,
        sql.with_(
            _ENRICH,
            "select 'companies' as object_type, cast(n as varchar) as object_id, "
            f"left({_COMPANY_NOTE_SQL}, 65536) as body from enriched where done",
        ),
    ),
    "bulk_company_notes": (
        bulk_company_notes,
        sql.with_(
            [roles.DOCS_SQL],
            "select 'companies' as object_type, cast(n as varchar) as object_id, 'Website content scraped:' "
            "|| chr(10) || chr(10) || left(text, 1000) || '...' as body from docs where length(text) > 100",
        ),
    ),
    "lead_notes": (
        lead_notes,
        sql.with_(
            [*_LEAD, _SITE_TEXT],
            f"select 'contacts' as object_type, email as object_id, left({_LEAD_NOTE_SQL}, 65536) as body "
            "from leads l join sites using (domain) where answered",
        ),
    ),
    "bulk_results": (
        bulk_results,
        sql.with_(
            _ENRICH,
            "select c.id, c.domain, case when e.done then 'completed' when e.n is not null then 'failed' end "
            "as enrichment_status, case when e.n is not null then "
            + _RESULT_ERROR.replace("success", "e.success").replace("error,", "e.error,")
            + " end as enrichment_error, case when e.answered then e.a_industry end as industry, "
            "cast(length(case when e.success then e.content end) as integer) as content_chars, "
            "c.name as original_name from companies c left join enriched e on c.domain = e.domain "
            "where c.domain is not null",
        ),
    ),
    "bulk_errors": (
        bulk_errors,
        sql.with_(
            [roles.COMPANIES_SQL],
            "select id, 'Company missing domain' as error, 'ValueError' as type from companies where domain is null",
        ),
    ),
    "bulk_lead_results": (
        bulk_lead_results,
        sql.with_(
            _BULK_LEADS,
            "select id, email, content as site_content, 'completed' as enrichment_status, "
            "persona as buyer_persona, score as lead_score_adjustment from judged join sites using (domain) "
            "where error is null",
        ),
    ),
    "bulk_lead_errors": (
        bulk_lead_errors,
        sql.with_(
            _BULK_LEADS, "select id, error, 'ValueError' as type from judged where error is not null"
        ),
    ),
    "bulk_company_updates": (
        bulk_company_updates,
        sql.with_(
            _ENRICH,
            f"select 'companies' as object_type, c.id, 'update' as action, {sql.properties(_SENT)} as properties "
            "from companies c left join enriched e on c.domain = e.domain where c.domain is not null",
        ),
    ),
    "bulk_lead_updates": (
        bulk_lead_updates,
        sql.with_(
            _BULK_LEADS,
            "select 'contacts' as object_type, id, 'update' as action, 'buyer_persona=' || persona || ';enrichment_status=completed;"
            "lead_score_adjustment=' || score || ';site_content=' || content as properties "
            "from judged join sites using (domain) where error is null",
        ),
    ),
    "crm_company_enrichment": (
        crm_company_enrichment,
        sql.with_(
            [*_ENRICH, _RUN_COMPANY],
            "select 'companies' as object_type, id, case when state = 'completed' then 'update' end as action, state, "
            "case state when 'no_domain' then case when coalesce(domain, '') = '' then 'No domain found' else 'Invalid domain: ' || domain end "
            "when 'scrape_failed' then 'Scraping failed: ' || case when success is null then 'not scraped' else coalesce(error, 'None') end "
            "when 'analysis_failed' then 'Analysis failed' end as reason, "
            f"case when state = 'completed' then {sql.properties(_UPDATE, ('enrichment_status',))} end as properties from states",
        ),
    ),
    "crm_lead_enrichment": (
        crm_lead_enrichment,
        sql.with_(
            [roles.MEMBERS_SQL, _RUN_LEAD],
            "select 'contacts' as object_type, cast(n as varchar) as id, case when state = 'completed' then 'update' end as action, state, "
            "case state when 'no_domain' then 'No domain found' when 'scrape_failed' then 'Scraping failed: timeout' "
            "when 'analysis_failed' then 'Analysis failed' end as reason, "
            f"case when state = 'completed' then {sql.properties(_LEAD_UPDATE)} end as properties from states",
        ),
    ),
    "apply_function": (
        apply_function,
        sql.with_(
            [roles.COMPANIES_SQL],
            "select id, case when contains(coalesce(domain, ''), '.') then upper(domain) end as upper, "
            "case when not contains(coalesce(domain, ''), '.') then 'bad domain: ' || coalesce(domain, '') end as error, "
            "case when not contains(coalesce(domain, ''), '.') then 'ValueError' end as type from companies",
        ),
    ),
}
