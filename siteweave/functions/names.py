"""Column functions that guess a person's name from an e-mail address."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siteweave.functions.text import strip, title_case


def parse_email_name(email: Column) -> Column:
    """First and last name from the first of ``.``, ``_``, ``-`` found in the local part.

    The outer parts are used; without a separator the whole local part is the first name. Null gives
    nulls.
    """
    local = F.substring_index(email, "@", 1)
    parts = (
        F.when(local.contains("."), F.split(local, r"\.", -1))
        .when(local.contains("_"), F.split(local, "_", -1))
        .when(local.contains("-"), F.split(local, "-", -1))
        .otherwise(F.array(local, F.when(local.isNotNull(), "")))
    )
    return F.struct(
        title_case(F.element_at(parts, 1)).alias("first_name"),
        title_case(F.element_at(parts, -1)).alias("last_name"),
    )


def guess_lead_name(email: Column) -> Column:
    """Name guess of the CRM lead rows: first word, then all further words of the local part.

    Both are empty where there is no address.
    """
    spaced = strip(F.translate(F.substring_index(email, "@", 1), "._-", "   "))
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(
        title_case(F.coalesce(F.get(words, F.lit(0)), F.lit(""))).alias("firstname"),
        title_case(F.coalesce(rest, F.lit(""))).alias("lastname"),
    )
