"""Queries over stored pages, domain lists and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave import schemas
from siteweave.catalog import roles, sql
from siteweave.fixed_values import LEAD_PROMPT
from siteweave.functions import analysis, domains, html, text
from siteweave.operators import crawl, domain_list, enrich, export, pages
from siteweave.plans.stages import fresh_path
from siteweave.sources import tables

def _scalar(name: str, column) -> callable:
    """A query that shows one function over all pages."""
    return lambda spark, sf: roles.pages(spark, sf).select("page_id", column().alias(name))


_BARE = "case when page_id % 2 = 0 then url else regexp_replace(url, '^[a-z]+://', '') end"
_SHOUT = "'  ' || upper(url) || ' '"


def domain_list_accept(spark: SparkSession, sf: str) -> DataFrame:
    return domain_list.accept(roles.lines(spark, sf))


def domain_list_reject(spark: SparkSession, sf: str) -> DataFrame:
    return domain_list.reject(roles.lines(spark, sf))


def domain_list_limit(spark: SparkSession, sf: str) -> DataFrame:
    return domain_list.limit_domains(domain_list_accept(spark, sf), 20)


_ENTRIES = (
    f"entries as (select line_no, {sql.strip('line')} as line, "
    f"{sql.extract_domain('line')} as domain from lines "
    f"where {sql.strip('line')} <> '' and not starts_with({sql.strip('line')}, '#'))"
)
_ACCEPTED = (
    "accepted as (select min(line_no) as line_no, domain from entries "
    "where domain is not null group by domain)"
)
_LIST = [roles.LINES_SQL, _ENTRIES, _ACCEPTED]


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    found = html.extract_links(F.col("html"), url, domains.url_host(url))
    return roles.pages(spark, sf).select("page_id", F.array_join(found, " ").alias("links"))


_SHAPES = (
    "concat('<a href=\"../up/x\">1</a><a href=\"./here\">2</a><a href=''next?a=1&amp;b=2#c''>3</a><a href=\"?q=1\">4</a><a href=\"//', "
    "{host}, '/g/\">5</a><link href=/r><a href=\"//other.org/z\">6</a><a href=\"/a/../b/./c\">7</a><a href=\"mailto:x@y.z\">8</a>')"
)


def extract_links_relative(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every shape a page can name its own site by."""
    url = F.col("url")
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    page = roles.pages(spark, sf).withColumn("host", host).withColumn("links_", F.expr(_SHAPES.format(host="host")))
    found = html.extract_links(F.concat("links_", "html"), url, domains.url_host(url))
    return page.select("page_id", F.array_join(F.slice(found, 1, 7), " ").alias("links"))


_RELATIVE_SQL = (
    "with p as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, regexp_extract(url, '^([a-z]+):', 1) as scheme, "
    "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) as path from pages), "
    "d as (select *, regexp_replace(path, '[^/]*$', '') as folder from p) "
    "select page_id, concat_ws(' ', root || regexp_replace(folder, '[^/]+/$', '') || 'up/x', root || folder || 'here', "
    "root || folder || 'next?a=1&b=2', root || path || '?q=1', scheme || '://' || host || '/g', root || '/r', root || '/b/c') as links from d"
)


def page_success(spark: SparkSession, sf: str) -> DataFrame:
    return pages.scrape(roles.pages(spark, sf)).select(
        "page_id", F.length("content").alias("n_chars"), "success", "error"
    )


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    """All stored pages of each host, combined in order of their number."""
    # the HTML is reduced to text in the scan stage and never shuffled
    read = pages.scrape(roles.page_content(spark, sf))
    return pages.combine_pages(read.withColumn("rank", F.col("page_id")))


def combine_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf).select(
        "domain", "url", "content", "success", "error",
        F.array_join("emails", " ").alias("emails"), "pages_scraped",
        F.array_join("scraped_urls", " ").alias("scraped_urls"),
    )


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return pages.site_content_record(_combined(spark, sf), F.to_timestamp(F.lit(roles.STAMP)))


def _shown(content: DataFrame) -> DataFrame:
    return content.select(
        "domain", "url", "success", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"),
        "content", F.array_join("emails", " ").alias("emails"), "error",
    )


def site_content_record(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_content(spark, sf))


def read_site_content(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "site-content")
    tables.write_stage(_content(spark, sf), path)
    return _shown(tables.read_site_content(spark, path))


_SCRAPED = (
    f"scraped as (select page_id, url, {sql.host('url')} as domain, {sql.html_text('html')} as content, "
    f"{sql.emails('html', sql.host('url'))} as emails from pages)"
)
_RANKED = (
    "ranked as (select *, row_number() over (partition by domain order by page_id) as rank "
    "from scraped)"
)
_COMBINED = (
    "combined as (select domain, arg_min(url, rank) as url, "
    f"{sql.strip('''coalesce(string_agg(case when length(content) > 100 then chr(10) || chr(10) || '=== Page: ' || url || ' ===' || chr(10) || content end, '' order by rank), '')''')} as content, "
    "count(*) filter (length(content) > 100) > 0 as success, "
    "case when count(*) filter (length(content) > 100) = 0 then 'No successful pages' end as error, "
    "coalesce(array_to_string(list_sort(list_distinct(flatten(list(emails) filter (length(content) > 100)))), ' '), '') as emails, "
    "count(*) as pages_scraped, string_agg(url, ' ' order by rank) as scraped_urls from ranked group by domain)"
)
_SITE = [_SCRAPED, _RANKED, _COMBINED]
_SHOWN_SQL = (
    "select domain, url, success, '2024-01-01 12:00:00' as scraped_at, "
    "case when success then content else '' end as content, emails, "
    "case when not success then error end as error from combined"
)


def _tree_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The sites of the linked pages, as a domain list gives them, and one site without any page."""
    host = F.regexp_extract("url", "^https://([^/]*)", 1)
    lines = roles.tree_pages(spark, sf).select((F.col("page_id") + 1).alias("line_no"), host.alias("line"))
    none = lines.limit(1).select(F.lit(0).cast("long").alias("line_no"), F.lit("none.example.com").alias("line"))
    return domain_list.accept(lines.unionByName(none)).select("domain")


def _crawled(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of links from the root of every site, through stored and missing pages."""
    starts = crawl.domain_starts(_tree_domains(spark, sf))
    rows = crawl.page_table(roles.tree_pages(spark, sf), starts=starts)
    visited = crawl.crawl(starts, rows, max_depth=2, max_pages=10)
    return crawl.crawled_pages(visited, rows)


def crawl_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _crawled(spark, sf).select(
        "domain", "url", "depth", "rank", "success", F.length("content").alias("n_chars"), "error"
    )


def crawl_depth_counts(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.depth_counts(_crawled(spark, sf))


def crawl_totals(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.crawl_totals(_crawled(spark, sf))


_CRAWL = [
    roles.TREE_SQL,
    f"scraped as (select page_id, url, rtrim(url, '/') as key, {sql.html_text('html')} as content, "
    f"{sql.emails('html', sql.host('url'))} as emails, {sql.links('html', 'url')} as l from tree)",
    "starts as (select distinct regexp_extract(url, '^https://([^/]*)', 1) as domain from scraped union all select 'none.example.com')",
    "v0 as (select domain, 'https://' || domain as key, 0 as depth, 1::bigint as rank from starts)",
    "n1 as (select domain, u.url as key, u.pos as pos from (select v.domain, unnest(list_transform(l, lambda x, i: "
    "{'url': x, 'pos': i})) as u from v0 v join scraped s on s.key = v.key and length(s.content) > 100))",
    "v1 as (select domain, key, 1 as depth, 1 + row_number() over (partition by domain order by pos) as rank from n1 "
    "where (domain, key) not in (select domain, key from v0) qualify rank <= 10)",
    "n2 as (select domain, u.url as key, parent, u.pos as pos from (select v.domain, v.rank as parent, unnest(list_transform(l, "
    "lambda x, i: {'url': x, 'pos': i})) as u from v1 v join scraped s on s.key = v.key and length(s.content) > 100))",
    "f2 as (select domain, key, min(parent * 1000 + pos) as place from n2 "
    "where (domain, key) not in (select domain, key from v0 union all select domain, key from v1) group by domain, key)",
    "v2 as (select domain, key, 2 as depth, m + row_number() over (partition by domain order by place) as rank from f2 "
    "join (select domain, 1 + count(*) as m from v1 group by domain) using (domain) qualify rank <= 10)",
    "visited as (select v.domain, coalesce(s.url, v.key) as url, depth, rank, coalesce(length(content) > 100, false) as success, "
    "coalesce(length(content), 0) as n_chars, coalesce(content, '') as content, emails, case when s.key is null then 'page is not stored' when length(content) <= 100 "
    "then 'Insufficient content scraped (only ' || length(content) || ' characters)' end as error "
    "from (select * from v0 union all select * from v1 union all select * from v2) v left join scraped s on s.key = v.key)",
]


def main_flow(spark: SparkSession, sf: str) -> DataFrame:
    """From a domain list to export rows: starts, crawl, one record a domain, analysis, company export."""
    domains_ = _tree_domains(spark, sf)
    combined = pages.with_missing_domains(pages.combine_pages(_crawled(spark, sf)), domains_)
    content = pages.site_content_record(combined, F.to_timestamp(F.lit(roles.STAMP)))
    answers = enrich.from_responses(_tree_answers(spark, sf))
    rows = export.company_export_rows(enrich.enrich_company(content, answers, F.lit(roles.STAMP)))
    scraped = combined.select("domain", "pages_scraped", F.array_join("scraped_urls", " ").alias("scraped_urls"))
    return rows.join(scraped, "domain")


def _tree_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An analyzer's answer for every second site."""
    number = F.regexp_extract("domain", "^t([0-9]+)", 1).try_cast("bigint")
    known = _tree_domains(spark, sf).withColumn("n", number).where("n % 2 = 0")
    answer = F.to_json(F.struct(
        F.struct(F.concat(F.lit("Site "), "domain").alias("business_type_description"), F.col("n").cast("string").alias("naics_code"))
        .alias("business_intelligence"),
        (F.col("n") % 10 + 1).cast("int").alias("confidence_score"),
    ))
    return known.select(F.col("domain").alias("key"), answer.alias("response_text"))


_FLOW_SQL = f"""
select v.domain, '{roles.STAMP}' as enriched_at, v.success, case when not v.success then 'Scraping failed: ' ||
    coalesce(v.error, '') else '' end as error, case when v.success then v.url else '' end as scraped_url,
  case when v.success then v.emails else '' end as emails_found,
  case when asked then 'Site ' || v.domain else '' end as business_type, case when asked then n::varchar else '' end as naics_code,
  '' as target_market, '' as products_services, '' as value_propositions, '' as competitive_advantages, '' as technologies, '' as certifications,
  '' as pain_points, case when asked then (n % 10 + 1) / 10.0::double else 0.0 end as confidence_score, pages_scraped, scraped_urls
from (
  select *, success and n % 2 = 0 and n_text >= 50 as asked from (
    select domain, arg_min(url, rank) as url, count(*) filter (success) > 0 as success, count(*) as pages_scraped,
      string_agg(url, ' ' order by rank) as scraped_urls, sum(n_chars) filter (success) as n_text,
      case when count(*) filter (success) = 0 then 'No successful pages' end as error,
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(emails) filter (success)))), ';'), '') as emails,
      try_cast(regexp_extract(domain, '^t([0-9]+)', 1) as bigint) as n
    from visited group by domain)) v
"""


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier export of the hosts with three pages or more, written and read back."""
    combined = _combined(spark, sf).where(F.col("success") & (F.col("pages_scraped") >= 3))
    content = pages.site_content_record(combined, F.to_timestamp(F.lit(roles.STAMP)))
    none = content.select("domain", F.lit(None).cast(schemas.COMPANY_ANALYSIS).alias("analysis"))
    rows = export.crm_company_rows(enrich.domain_results(content, none))
    path = fresh_path(spark, "export")
    tables.write_csv(rows.select("`Company Domain Name`", "Name", "`Enrichment Status`"), path)
    return tables.existing_domains(tables.read_csv(spark, path))


def resume_existing_domains(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf)


def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    left = domain_list.remaining(domain_list_accept(spark, sf), _exported(spark, sf))
    return left.select("domain")


def stage_pending(spark: SparkSession, sf: str) -> DataFrame:
    content = roles.doc_content(spark, sf)
    stage = enrich.company_analyses(roles.company_responses(spark, sf))
    return domain_list.stage_pending(content.select("domain"), stage)


def extract_emails(spark: SparkSession, sf: str) -> DataFrame:
    found = html.extract_emails(F.col("text"), F.lit("example.com"))
    return roles.table(spark, sf, "documents").select(
        "doc_id", F.array_join(found, " ").alias("emails"), F.size(found).alias("n_emails")
    )


_LINKED = (
    "text || ' see https://d' || cast(doc_id % 7 as string) || '.example.com/p/' || cast(doc_id as string) "
    "|| '/, http://example.com. (https://other.org/x) https://example.com:8080/q http://www.example.com/!'"
)


def extract_links_text(spark: SparkSession, sf: str) -> DataFrame:
    found = html.extract_links_from_text(F.expr(_LINKED), F.lit("example.com"))
    return roles.table(spark, sf, "documents").select("doc_id", F.array_join(found, " ").alias("links"))


_LINKS_TEXT_SQL = r"""
with raw as (select doc_id, list_transform(regexp_extract_all({t},
  'https?://[^\s<>"{{}}|\\^`\[\]]+[^\s<>"{{}}|\\^`\[\].,;:!?'')\]}}]'), lambda u: rtrim(u, '.,;:!?''"')) as l
  from documents),
kept as (select doc_id, list_transform(list_filter(l, lambda u:
  regexp_matches(u, '^https?://(www\.)?([^/?#]*\.)?example\.com([/?#]|$)')), lambda u: rtrim(u, '/')) as l from raw)
select doc_id, array_to_string(list_filter(l, lambda u, i: list_position(l, u) = i), ' ') as links from kept
""".format(t=_LINKED)


def truncate_field(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return roles.table(spark, sf, "documents").select(
        "doc_id",
        text.truncate_field(t, 255).alias("standard"),
        text.truncate_field(t, 65536).alias("description"),
    )


def lead_prompt(spark: SparkSession, sf: str) -> DataFrame:
    company = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    email = F.when(F.col("doc_id") % 3 == 0, F.lit("nobody")).otherwise(
        F.concat(F.lit("info@"), company)
    )
    first = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    prompt = analysis.lead_prompt(F.col("text"), first, F.col("source"), company, email)
    return roles.table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


def _prompt_sql() -> str:
    values = [
        "coalesce(case when doc_id % 2 = 0 then lang end, '')", "source", "'c' || doc_id",
        "case when doc_id % 3 = 0 then 'nobody' else 'info@c' || doc_id end",
        "case when doc_id % 3 = 0 then 'Unknown' else 'c' || doc_id end", "left(text, 4000)",
    ]
    layout = "'" + LEAD_PROMPT.replace("'", "''") + "'"
    for value in values:
        layout = layout.replace("%s", f"' || {value} || '", 1)
    return f"select doc_id, {layout} as prompt from documents"


QUERIES = {
    "extract_domain": (
        _scalar("domain", lambda: domains.extract_domain(F.expr(_BARE))),
        f"select page_id, {sql.extract_domain(_BARE)} as domain from pages",
    ),
    "normalize_url": (
        _scalar("normalized", lambda: domains.normalize_url(F.expr(f"' ' || {_BARE}"))),
        "select page_id, case when page_id % 2 = 0 then url else 'https://' || "
        "regexp_replace(url, '^[a-z]+://', '') end as normalized from pages",
    ),
    "normalize_domain": (
        _scalar("domain", lambda: domains.normalize_domain(F.expr(_SHOUT))),
        "select page_id, lower(url) as domain from pages",
    ),
    "domain_safe": (
        _scalar("safe", lambda: domains.domain_safe(F.col("url"))),
        "select page_id, replace(replace(url, '/', '_'), ':', '') as safe from pages",
    ),
    "url_host": (
        _scalar("host", lambda: domains.url_host(F.col("url"))),
        f"select page_id, {sql.host('url')} as host from pages",
    ),
    "domain_list_accept": (
        domain_list_accept, sql.with_(_LIST, "select line_no, domain from accepted")
    ),
    "domain_list_reject": (
        domain_list_reject,
        sql.with_(
            _LIST,
            "select line_no, case when domain is null then 'invalid' else 'duplicate' end as reason, "
            "'Line ' || line_no || case when domain is null then ': Invalid domain/URL ''' || line "
            "else ': Duplicate domain ''' || domain end || '''' as message "
            "from entries where line_no not in (select line_no from accepted)",
        ),
    ),
    "domain_list_limit": (
        domain_list_limit,
        sql.with_(_LIST, "select line_no, domain from accepted order by line_no limit 20"),
    ),
    "html_to_text": (
        _scalar("content", lambda: html.html_to_text(F.col("html"))),
        f"select page_id, {sql.html_text('html')} as content from pages",
    ),
    "extract_links": (
        extract_links,
        f"select page_id, {sql.joined(sql.links('html', 'url'))} as links from pages",
    ),
    "extract_links_relative": (extract_links_relative, _RELATIVE_SQL),
    "page_success": (
        page_success,
        sql.with_(
            [_SCRAPED],
            "select page_id, cast(length(content) as integer) as n_chars, length(content) > 100 as success, "
            "case when length(content) <= 100 then 'Insufficient content scraped (only ' || "
            "length(content) || ' characters)' end as error from scraped",
        ),
    ),
    "combine_pages": (
        combine_pages,
        sql.with_(
            _SITE,
            "select domain, url, content, success, error, emails, pages_scraped, scraped_urls from combined",
        ),
    ),
    "site_content_record": (site_content_record, sql.with_(_SITE, _SHOWN_SQL)),
    "read_site_content": (read_site_content, sql.with_(_SITE, _SHOWN_SQL)),
    "crawl_pages": (
        crawl_pages,
        sql.with_(
            _CRAWL,
            "select domain, url, cast(depth as integer) as depth, cast(rank as integer) as rank, success, "
            "cast(n_chars as integer) as n_chars, error from visited",
        ),
    ),
    "crawl_depth_counts": (
        crawl_depth_counts,
        sql.with_(
            _CRAWL,
            "select cast(depth as integer) as depth, count(*) as pages, "
            "count(*) filter (success) as successful_pages from visited group by depth",
        ),
    ),
    "crawl_totals": (
        crawl_totals,
        sql.with_(
            _CRAWL,
            "select domain, count(distinct url) as total_pages, "
            "cast(len(list_distinct(flatten(list(coalesce(emails, []))))) as bigint) as unique_emails "
            "from visited group by domain",
        ),
    ),
    "main_flow": (main_flow, sql.with_(_CRAWL, _FLOW_SQL)),
    "resume_existing_domains": (
        resume_existing_domains, sql.with_(_SITE, "select domain from combined where success and pages_scraped >= 3")
    ),
    "resume_remaining": (
        resume_remaining,
        sql.with_(
            [*_LIST, *_SITE],
            "select domain from accepted where domain not in (select domain from combined where success and pages_scraped >= 3)",
        ),
    ),
    "stage_pending": (
        stage_pending,
        sql.with_(
            [roles.DOCS_SQL],
            "select domain from docs where n not in (select s_suppkey from supplier)",
        ),
    ),
    "extract_emails": (
        extract_emails,
        f"select doc_id, {sql.joined('e')} as emails, cast(len(e) as integer) as n_emails from "
        f"(select doc_id, {sql.emails('text', chr(39) + 'example.com' + chr(39))} as e from documents)",
    ),
    "extract_links_text": (extract_links_text, _LINKS_TEXT_SQL),
    "truncate_field": (
        truncate_field,
        f"select doc_id, {sql.truncate('text', 255)} as standard, "
        f"{sql.truncate('text', 65536)} as description from documents",
    ),
    "lead_prompt": (lead_prompt, _prompt_sql()),
}
