"""Breadth-first crawl over stored pages, as a fixed number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siteweave.fixed_values import DEFAULT_DEPTH, DEFAULT_MAX_PAGES
from siteweave.functions.domains import host_or_empty, url_host, url_key
from siteweave.functions.html import internal_links, page_links
from siteweave.functions.text import let
from siteweave.operators.pages import scrape
from siteweave.plans.skew import attach
from siteweave.plans.stages import bucketed, written

_NOT_STORED = "page is not stored"
_LAST_TWO_LABELS = r"([^.]*\.[^.]*)$"


def _under_starts(pages: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """``(url, key)`` of the pages on the host of a start or below it. Reads only these columns."""
    labels = F.split(url_host(F.col("url")), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    bases = starts.select(url_host(F.col("url")).alias("base")).distinct()
    columns = list(dict.fromkeys(["url", key]))
    rows = pages.select(*columns, F.explode(parents).alias("base"))
    return attach(rows, bases, "base", key, "left_semi").select(*columns).distinct()


def page_table(
    pages: DataFrame, path: str | None = None, starts: DataFrame | None = None
) -> DataFrame:
    """Everything a crawl needs of each stored page, written once: ``(key, url, success, links, …)``.

    Pages are told apart by :func:`url_key`, as links are; ``url`` keeps the stored spelling. Of
    several pages with one key the one with the smallest ``page_id`` counts (without that column:
    the smallest text). Every page is reduced in the scan stage, so HTML is never shuffled. Links
    that cannot belong to any domain of the page are left out: both hosts must end in the same two
    labels. With the ``starts`` of a crawl only pages that can be reached from them are kept.
    """
    site = F.regexp_extract(url_host(F.col("url")), _LAST_TWO_LABELS, 1)
    near = let(
        site,
        lambda own: F.filter(
            page_links(F.col("html"), F.col("url")),
            lambda u: F.regexp_extract(host_or_empty(u), _LAST_TWO_LABELS, 1) == own,
        ),
    )
    facts = ["content", "success", "links", "emails", "error"]
    slim = scrape(pages.withColumn("links", near))
    key = "page_id" if "page_id" in pages.columns else "url"
    wanted = pages if starts is None else _under_starts(pages, starts, key)
    if key == "page_id":
        firsts = wanted.groupBy(url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"))
        # an inner join: a semi join would be moved below the reduction, back onto the HTML
        unique = slim.join(firsts, "page_id").select("key", "url", *facts)
    else:
        kept = slim if starts is None else slim.join(wanted.distinct(), "url")
        keyed = kept.groupBy(url_key(F.col("url")).alias("key"))
        unique = keyed.agg(F.min(F.struct(*facts, "url")).alias("p")).select("key", "p.*")
    return written(unique, "pages", path)


def domain_starts(domains: DataFrame) -> DataFrame:
    """Start of each domain: its root over https."""
    return domains.select("domain", F.concat(F.lit("https://"), "domain").alias("url")).distinct()


def crawl(
    starts: DataFrame,
    page_rows: DataFrame,
    max_depth: int = DEFAULT_DEPTH,
    max_pages: int = DEFAULT_MAX_PAGES,
) -> DataFrame:
    """Pages visited from each start: ``(domain, url, depth, rank)`` with :func:`url_key` as url, at most ``max_pages`` per domain.

    ``starts`` holds ``(domain, url)``, one row per domain; ``page_rows`` comes from
    :func:`page_table`. Links are followed within the start URL's host. A page's children rank after
    the page, so keeping the first ``max_pages`` after every step visits exactly the pages a queue
    would. Only successful pages above ``max_depth`` are expanded, so the state holds at most
    ``max_pages`` rows per domain and a step adds at most ``max_pages`` times twice that many.
    """
    links = page_rows.where(F.col("success")).select(F.col("key").alias("url"), "links")
    visited = (
        starts.groupBy("domain")
        .agg(F.min("url").alias("url"))
        .select(
            "domain",
            url_key(F.col("url")).alias("url"),
            url_host(F.col("url")).alias("base"),
            F.lit(0).alias("depth"),
            F.lit(1).alias("rank"),
        )
    )
    visited = written(visited, "visited")
    # dealt by URL once; from then on a step moves the pages it starts from, not the links
    with bucketed(links, "links", "url") as edges:
        for depth in range(max_depth):
            # the next step reads the state twice; written, the plan stays one step long
            visited = written(_step(visited, edges, depth, max_pages), "visited")
    return visited.select("domain", "url", "depth", "rank")


def _step(visited: DataFrame, edges: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """The pages visited after following the links of those of one depth."""
    frontier = visited.where(F.col("depth") == depth)
    inside = internal_links(F.col("links"), F.col("base"))
    # Of a page's links at most max_pages were visited before and at most max_pages can be
    # visited now, so later ones cannot count.
    children = frontier.join(edges, "url").select(
        "domain",
        "base",
        F.lit(depth + 1).alias("depth"),
        F.col("rank").alias("parent"),
        F.posexplode(F.slice(inside, 1, 2 * max_pages)).alias("pos", "url"),
    )
    known = visited.select(
        "domain", "base", "depth", F.col("rank").alias("parent"), F.lit(0).alias("pos"), "url"
    )
    place = F.struct("depth", "parent", "pos")
    # one shuffle on the domain serves both the grouping and the queue below
    both = known.unionByName(children).repartition("domain")
    unique = both.groupBy("domain", "base", "url").agg(F.min(place).alias("place"))
    queue = Window.partitionBy("domain").orderBy("place.depth", "place.parent", "place.pos")
    return (
        unique.withColumn("rank", F.row_number().over(queue))
        .where(F.col("rank") <= max_pages)
        .select("domain", "url", "base", F.col("place.depth").alias("depth"), "rank")
    )


def crawled_pages(visited: DataFrame, page_rows: DataFrame) -> DataFrame:
    """The visited pages with their text, in the stored spelling. Others are failed pages."""
    facts = page_rows.select("key", F.col("url").alias("stored"), "success", "content", "emails", "error")
    return visited.join(facts, visited.url == facts.key, "left").select(
        "domain",
        F.coalesce("stored", "url").alias("url"),
        "depth",
        "rank",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("emails", F.expr("cast(array() as array<string>)")).alias("emails"),
        F.when(F.col("success").isNull(), _NOT_STORED).otherwise(F.col("error")).alias("error"),
    )


def depth_counts(crawled: DataFrame) -> DataFrame:
    """Visited and successful pages per depth."""
    return crawled.groupBy("depth").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("success").alias("successful_pages")
    )


def crawl_totals(crawled: DataFrame) -> DataFrame:
    """Visited pages and distinct addresses per domain."""
    per_page = crawled.select("domain", "url", F.explode_outer("emails").alias("email"))
    return per_page.groupBy("domain").agg(
        F.countDistinct("url").alias("total_pages"), F.countDistinct("email").alias("unique_emails")
    )
