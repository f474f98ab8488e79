"""All registered queries: name -> (Spark query, checking SQL or None)."""

from __future__ import annotations

from siteweave.catalog import crm_queries, enrich_queries, page_queries

QUERIES = {
    **page_queries.QUERIES,
    **enrich_queries.QUERIES,
    **crm_queries.QUERIES,
}
