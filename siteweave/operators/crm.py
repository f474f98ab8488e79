"""Work against a CRM snapshot: create/update actions, look-ups and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.functions.crm import import_company_properties, import_contact_properties
from siteweave.functions.domains import search_key
from siteweave.functions.text import or_empty, strip
from siteweave.operators.text_search import containing
from siteweave.plans.skew import attach, first_per_key
from siteweave.plans.stages import written


def _actions(valid: DataFrame, existing: DataFrame, hot_rows: int | None) -> DataFrame:
    """Create or update per row. ``valid`` has seq, key and properties; ``existing`` key and id.

    A key in the CRM is an update. Otherwise its first row creates it and later rows update what
    that row created (``created_by`` names the creating row). Both facts are known per key, from
    pre-aggregated tables with one row per key, and are attached to the rows skew-safely.
    """
    ids = existing.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id"))
    facts = first_per_key(valid, "key", "seq").withColumnRenamed("seq", "first_seq")
    facts = facts.join(ids, "key", "left")
    joined = attach(valid, facts, "key", "seq", hot_rows=hot_rows)
    creates = F.col("id").isNull() & (F.col("seq") == F.col("first_seq"))
    return joined.select(
        "seq",
        "key",
        F.when(creates, "create").otherwise("update").alias("action"),
        "id",
        F.when(F.col("id").isNull() & ~creates, F.col("first_seq")).alias("created_by"),
        "properties",
    )


def importable_companies(records: DataFrame) -> DataFrame:
    """Import rows with a domain and a successful enrichment."""
    key = strip(or_empty(F.col("domain")))
    usable = (F.lower(or_empty(F.col("success").cast("string"))) == "true") & (key != "")
    return records.where(usable).select(
        "seq", key.alias("key"), import_company_properties(records).alias("properties")
    )


def importable_contacts(records: DataFrame) -> DataFrame:
    """Import rows with an e-mail address."""
    key = strip(or_empty(F.col("email")))
    return records.where(key != "").select(
        "seq", key.alias("key"), import_contact_properties(records).alias("properties")
    )


def import_company_actions(
    records: DataFrame, crm: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Actions of a company import: ``seq`` orders the rows, ``crm`` has id and domain."""
    existing = crm.select(F.col("domain").alias("key"), "id")
    return _actions(importable_companies(records), existing, hot_rows)


def import_contact_actions(
    records: DataFrame, crm: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    existing = crm.select(F.col("email").alias("key"), "id")
    return _actions(importable_contacts(records), existing, hot_rows)


def _tokens(c: Column) -> Column:
    """Runs of letters, digits, dots and dashes of a lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}.-]+)"), F.lit(1))


def _first_by_token(companies: DataFrame, column: str) -> DataFrame:
    """Smallest id per token of a column."""
    tokens = companies.select("id", F.explode(F.array_distinct(_tokens(F.col(column)))).alias("key"))
    return tokens.groupBy("key").agg(F.min("id").alias("id"))


def lookup_company(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """First hit per requested domain: ``(domain, key, tier, id)``.

    Tier 1 finds the key among the tokens of the domains, tier 2 among those of the websites, tier
    3 inside a name or description, white space included. Within a tier the smallest id wins; no hit
    leaves tier and id null. ``requests`` has ``domain``; ``companies`` id, name, domain, website,
    description.
    """
    asked = requests.select("domain", search_key(F.col("domain")).alias("key"))
    keys = asked.select("key").where(F.col("key") != "").distinct()
    tiers = [
        _first_by_token(companies, "domain").withColumnRenamed("id", "id1"),
        _first_by_token(companies, "website").withColumnRenamed("id", "id2"),
    ]
    found = keys
    for tier in tiers:
        found = found.join(tier, "key", "left")
    # several steps look at the open keys; written, the first two tiers run once
    found = written(found, "looked-up")
    unmatched = found.where(F.col("id1").isNull() & F.col("id2").isNull())
    hits = containing(unmatched, companies, ["name", "description"])
    text_hits = hits.groupBy("key").agg(F.min("id").alias("id3"))
    best = found.join(text_hits, "key", "left").select(
        "key",
        F.when(F.col("id1").isNotNull(), 1)
        .when(F.col("id2").isNotNull(), 2)
        .when(F.col("id3").isNotNull(), 3)
        .alias("tier"),
        F.coalesce("id1", "id2", "id3").alias("id"),
    )
    return attach(asked, best, "key", "domain")


def lookup_contact(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """First contact (smallest id) per requested e-mail address, ignoring case."""
    firsts = (
        contacts.where(F.col("email").isNotNull())
        .groupBy(F.lower("email").alias("key"))
        .agg(F.min("id").alias("id"))
    )
    asked = requests.select("email", F.lower("email").alias("key"))
    return attach(asked, firsts, "key", "email").select("email", "id")


def lookup_by_id(ids: DataFrame, records: DataFrame) -> DataFrame:
    """The record of each requested id; a missing one leaves the fields null."""
    return ids.select("id").distinct().join(records, "id", "left")


def notes(object_type: str, rows: DataFrame, body: Column) -> DataFrame:
    """Note records ``(object_type, object_id, body)`` of the rows with a text."""
    return rows.select(
        F.lit(object_type).alias("object_type"), F.col("id").alias("object_id"), body.alias("body")
    ).where(F.col("body").isNotNull())
