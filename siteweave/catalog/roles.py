"""The driver's tables in the roles of the engine's inputs.

Each role is a fixed projection of a whole table, written in expressions that Spark and the checking
database read alike, so both sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave.fixed_values import COMPANY_PROPERTIES, CONTACT_PROPERTIES, INDUSTRY_CODES
from siteweave.functions.domains import url_host
from siteweave.functions.html import extract_emails, page_error, page_success

STAMP = "2024-01-01T12:00:00"


def _domain(number: str) -> str:
    return f"'c' || cast({number} as string) || '.example.com'"


_CONTACT_HOST = _domain("c_custkey % 50")
LINE = {
    "line_no": "page_id + 1",
    "line": "case when page_id % 25 = 3 then ' # note' when page_id % 25 = 7 then '' "
    "when page_id % 25 = 11 then 'nodomain' else url end",
}
CONTACT = {
    "n": "c_custkey",
    "id": "cast(c_custkey as string)",
    "email": f"case when c_custkey % 17 = 3 then null else lower(replace(c_name, '#', '.')) || "
    f"case when c_custkey % 3 = 0 then '_jr' else '' end || '@' || {_CONTACT_HOST} end",
    "firstname": "case when c_custkey % 4 = 1 then 'First' || cast(c_custkey as string) end",
    "lastname": "case when c_custkey % 4 = 1 then c_mktsegment end",
    "company": _CONTACT_HOST,
    "website": f"case when c_custkey % 5 = 0 then 'https://www.' || {_CONTACT_HOST} || '/about' "
    "when c_custkey % 7 = 0 then 'no site' end",
    "site_content": "case when c_custkey % 6 = 0 then c_name end",
    "enrichment_status": "case when c_acctbal > 0 then 'completed' else 'pending' end",
    "enrichment_date": f"'{STAMP}'",
    "buyer_persona": "c_mktsegment",
    "lead_score_adjustment": "cast(cast(floor(c_acctbal / 1000.0) as int) as string)",
}

_LABELS = [*INDUSTRY_CODES, "Mining"]
_LABEL_CASE = (
    "case s_suppkey % 11 "
    + " ".join(f"when {i} then '{label}'" for i, label in enumerate(_LABELS))
    + " end"
)
_COMPANY_HOST = _domain("s_suppkey")
COMPANY = {
    "n": "s_suppkey",
    "id": "cast(s_suppkey as string)",
    "name": "case when s_suppkey % 29 = 5 then null else s_name end",
    "domain": "case when s_suppkey % 11 = 4 then null when s_suppkey % 13 = 5 then 'x.y' "
    f"when s_suppkey % 17 = 6 then 'nodots' else {_COMPANY_HOST} end",
    "website": f"case when s_suppkey % 3 = 0 then 'https://www.' || {_COMPANY_HOST} || '/' end",
    "description": f"case when s_suppkey % 4 = 0 then 'Site of ' || {_domain('s_suppkey + 500')} || "
    "' in ' || n_name when s_suppkey % 4 = 1 then '' end",
    "city": "case when s_suppkey % 2 = 0 then n_name end",
    "state": "case when s_suppkey % 3 = 1 then r_name end",
    "country": "case when s_suppkey % 6 = 0 then n_name else '' end",
    "timezone": "case when s_suppkey % 5 = 1 then 'UTC' end",
    "site_content": "case when s_suppkey % 5 = 0 then 'text of ' || s_name end",
    "enrichment_status": "case when s_acctbal > 0 then 'completed' else 'pending' end",
    "enrichment_date": f"'{STAMP}'",
    "numberofemployees": "case when s_suppkey % 2 = 1 then cast(s_suppkey as string) || '-500' end",
    "annualrevenue": "case when s_suppkey % 3 = 0 then '$' || cast(s_suppkey % 40 as string) || 'M-$90M' "
    "else '' end",
    "industry": _LABEL_CASE,
    "business_type_description": "case when s_suppkey % 8 <> 0 then 'Type ' || r_name end",
    "naics_code": "cast(s_suppkey + 1000 as string)",
    "target_market": "r_name",
    "primary_products_services": "'one, two'",
    "value_propositions": "''",
    "competitive_advantages": "cast(null as string)",
    "technologies_used": "'SQL'",
    "certifications_awards": "cast(null as string)",
    "pain_points_addressed": "cast(null as string)",
    "confidence_score": "cast(cast(s_suppkey % 10 as double) / 10 as string)",
}

IMPORT = {
    "seq": "o_orderkey",
    "domain": "case when o_orderkey % 97 = 0 then ' ' "
    f"else {_domain('o_custkey % 200')} end",
    "success": "case when o_orderstatus <> 'P' then 'True' else 'False' end",
    "business_type": "o_orderpriority",
    "naics_code": "case when o_orderkey % 3 = 0 then cast(o_custkey as string) else '' end",
    "target_market": "''",
    "confidence_score": "cast(cast(o_orderkey % 10 as double) / 10 as string)",
    "products_services": "case when o_orderkey % 2 = 0 then 'a;b' end",
    "enriched_at": f"'{STAMP}'",
}

CONTACT_IMPORT = {
    "seq": "o_orderkey",
    "email": "case when o_orderkey % 89 = 0 then '' "
    "when o_custkey % 4 = 0 then 'guest.' || cast(o_custkey as string) || '@example.com' "
    "else lower('Customer.' || right('000000000' || cast(o_custkey as string), 9)) || "
    "case when o_custkey % 3 = 0 then '_jr' else '' end || '@' || "
    f"{_domain('o_custkey % 50')} end",
    "first_name": "case when o_orderkey % 2 = 0 then 'Ann' else '' end",
    "last_name": "o_orderstatus",
    "company_domain": _domain("o_custkey % 50"),
    "buyer_persona": "o_orderpriority",
    "lead_score_adjustment": "cast(o_orderkey % 8 as string)",
    "enriched_at": f"'{STAMP}'",
}

METRIC = {
    "n": "event_id",
    "domain": _domain("user_id"),
    "duration": "case when event_id % 10 = 0 then 0.0 else value end",
    "success": "event_type <> 'error'",
    "error": "case when event_type = 'error' and event_id % 3 > 0 then props end",
    "content_size": "event_id % 1000",
    "emails_found": "event_id % 4",
}

OUTCOME = {
    "seq": "event_id",
    "run": "user_id % 20",
    "company": _domain("user_id"),
    "domain": f"case when event_id % 9 = 0 then null else {_domain('user_id')} end",
    "website": "case when event_id % 18 = 0 then 'https://example.org' end",
    "enriched": "event_type in ('click', 'view', 'purchase')",
    "error": "case when event_type = 'error' then case when event_id % 2 = 0 then "
    "'Connection Timeout after ' || props else 'refused ' || props end end",
}

# Sites of forty stored pages each, linked as a tree: page i names pages 3i + 1 to 3i + 3, its parent, a
# page elsewhere and, for some, one that is not stored. The links that the pages have themselves go.
_TREE, _PLACE = "cast(floor(page_id / 40.0) as bigint)", "page_id % 40"


def _tree_link(number: str) -> str:
    return f"'<a href=\"/p' || cast({number} as string) || '\">x</a>'"


TREE_PAGE = {
    "page_id": "page_id",
    "url": f"'https://t' || cast({_TREE} as string) || '.example.com' || case when {_PLACE} = 0 then '/' "
    f"else '/p' || cast({_PLACE} as string) end",
    "html": "concat("
    + ", ".join(_tree_link(f"3 * ({_PLACE}) + {i}") for i in (1, 2, 3))
    + ", '<a href=\"/\">up</a>'"
    + f", case when {_PLACE} % 4 = 1 then {_tree_link('page_id + 1000')} else '' end"
    + """, replace(html, ' href="/', ' data-x="/'))""",
}

# One site per four customers: the address list of a site stays at four whatever the scale.
_SITE = "cast(floor(c_custkey / 4.0) as bigint)"
SITE_MEMBER = {
    "n": "c_custkey",
    "domain": f"'g' || cast({_SITE} as string) || '.example.com'",
    "site": _SITE,
    "email": f"lower(replace(c_name, '#', '.')) || '@g' || cast({_SITE} as string) || '.example.com'",
    "name": "c_name",
    "persona": "c_mktsegment",
    "score": "cast(floor(c_acctbal / 1000.0) as int)",
}

DOC = {
    "n": "doc_id",
    "domain": _domain("doc_id"),
    "url": f"'https://' || {_domain('doc_id')}",
    "text": "text",
}


def cte(role: dict[str, str], source: str) -> str:
    """The role as a sub-select for the checking SQL."""
    return "select " + ", ".join(f"{e} as {c}" for c, e in role.items()) + f" from {source}"


COMPANY_SOURCE = (
    "supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
)
LINES_SQL = f"lines as ({cte(LINE, 'pages')})"
CONTACTS_SQL = f"contacts as ({cte(CONTACT, 'customer')})"
COMPANIES_SQL = f"companies as ({cte(COMPANY, COMPANY_SOURCE)})"
IMPORTS_SQL = f"imports as ({cte(IMPORT, 'orders')})"
CONTACT_IMPORTS_SQL = f"contact_imports as ({cte(CONTACT_IMPORT, 'orders')})"
METRICS_SQL = f"metrics as ({cte(METRIC, 'events')})"
OUTCOMES_SQL = f"outcomes as ({cte(OUTCOME, 'events')})"
MEMBERS_SQL = f"members as ({cte(SITE_MEMBER, 'customer')})"
TREE_SQL = f"tree as ({cte(TREE_PAGE, 'pages')})"
DOCS_SQL = f"docs as ({cte(DOC, 'documents')})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _project(df: DataFrame, role: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in role.items()])


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "pages"), LINE)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def tree_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "pages"), TREE_PAGE)


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "customer"), CONTACT)


def contact_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return contacts(spark, sf).select("id", F.struct(*CONTACT_PROPERTIES).alias("properties"))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    joined = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return _project(joined, COMPANY)


def company_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return companies(spark, sf).select("id", F.struct(*COMPANY_PROPERTIES).alias("properties"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), IMPORT)


def contact_imports(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), CONTACT_IMPORT)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "events"), METRIC)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "events"), OUTCOME)


def doc_content(spark: SparkSession, sf: str) -> DataFrame:
    """Site content from the documents: one domain per document, addresses below example.com."""
    docs = _project(table(spark, sf, "documents"), DOC)
    ok = page_success(F.col("text"))
    return docs.select(
        "n",
        "domain",
        "url",
        ok.alias("success"),
        F.to_timestamp(F.lit(STAMP)).alias("scraped_at"),
        F.when(ok, F.col("text")).otherwise("").alias("content"),
        extract_emails(F.col("text"), F.lit("example.com")).alias("emails"),
        F.when(F.col("n") % 2 == 0, page_error(F.col("text"))).alias("error"),
    )


def company_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Analyzer answers for the companies' hosts: JSON, some failed, some broken, some unscored."""
    c = companies(spark, sf).withColumn("key", F.expr(_domain("n")))
    none = F.lit(None).cast("string")
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("name"), F.col("description"), F.col("industry"), F.col("city"), F.col("state"),
                none.alias("zip"), F.col("country"), F.col("numberofemployees"), F.col("annualrevenue"),
            ).alias("company"),
            F.struct(
                F.col("business_type_description"), F.col("naics_code"), F.col("target_market"),
                F.array(F.lit("one"), F.coalesce("state", F.lit("two"))).alias("primary_products_services"),
                F.array(F.coalesce("name", F.lit("none"))).alias("technologies_used"),
            ).alias("business_intelligence"),
            F.when(F.col("n") % 7 != 0, (F.col("n") % 10 + 1).cast("int")).alias("confidence_score"),
        )
    )
    text = (
        F.when(F.col("n") % 19 == 7, '{"_error": "rate limit"}')
        .when(F.col("n") % 23 == 8, "no answer")
        .otherwise(body)
    )
    return c.select("n", "key", text.alias("response_text"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "customer"), SITE_MEMBER)


def site_content(spark: SparkSession, sf: str) -> DataFrame:
    """Site content with addresses: one record per four customers."""
    grouped = members(spark, sf).groupBy("domain", "site").agg(
        F.array_sort(F.collect_list(F.struct("n", "email", "name"))).alias("m")
    )
    ok = F.col("site") % 5 != 3
    text = F.array_join(F.transform("m", lambda x: x["name"]), " and ")
    return grouped.select(
        "domain",
        F.concat(F.lit("https://"), "domain").alias("url"),
        ok.alias("success"),
        F.to_timestamp(F.lit(STAMP)).alias("scraped_at"),
        F.when(ok, text).otherwise("").alias("content"),
        F.when(F.col("site") % 7 == 2, F.expr("cast(array() as array<string>)"))
        .otherwise(F.transform("m", lambda x: x["email"]))
        .alias("emails"),
        F.when(~ok, "timeout").alias("error"),
    )


def lead_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Analyzer answers for the site members: text around a JSON object, some without a key."""
    m = members(spark, sf)
    whole = F.to_json(
        F.struct(
            F.col("persona").alias("buyer_persona"),
            F.col("score").alias("lead_score_adjustment"),
            F.lit(0.5).alias("confidence"),
            F.col("name").alias("reasoning"),
        )
    )
    part = F.to_json(F.struct(F.col("persona").alias("buyer_persona")))
    text = F.concat(
        F.lit("My answer: "), F.when(F.col("n") % 9 == 1, part).otherwise(whole), F.lit(" Done.")
    )
    return m.select("n", F.col("email").alias("key"), text.alias("response_text"))


def page_content(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).withColumn("domain", url_host(F.col("url")))
