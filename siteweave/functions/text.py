"""Column functions on plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from siteweave.fixed_values import SPACES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    A lambda of ``filter`` or ``transform`` that names an outer expression evaluates it again for
    every element; binding it to a lambda variable keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """True when a text is neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def truncate_field(c: Column, limit: int) -> Column:
    """Null becomes empty, each line break one space, and the text is cut to ``limit`` characters."""
    return F.substring(F.translate(or_empty(c), "\n\r", "  "), 1, limit)


def format_confidence(c: Column) -> Column:
    """A score as text with at most two decimals; zero, null and non-numbers give an empty text."""
    score = c.try_cast("double")
    return F.when(score.isNull() | F.isnan(score) | (score == 0), "").otherwise(
        F.bround(score, 2).cast("string")
    )


def round_1(c: Column) -> Column:
    """A non-negative number to one decimal: its exact binary value, ties to even.

    ``round`` and Java's ``%.1f`` round the shortest decimal text half up, which differs at ties and
    where the text only looks like one. The fraction is an exact multiple of 2^-60, or too small to
    matter, so whole-number arithmetic decides. Numbers from 2^53 on have no fraction.
    """

    def rounded(x: Column) -> Column:
        whole = F.floor(x)
        units = F.floor((x - whole) * float(1 << 60)).cast("decimal(20,0)") * 10
        return let(F.struct(whole.alias("whole"), units.alias("units")), tenths)

    def tenths(p: Column) -> Column:
        one, half = F.lit(1 << 60).cast("decimal(20,0)"), F.lit(1 << 59).cast("decimal(20,0)")
        rest = p["units"] % one
        low = ((p["units"] - rest) / one).cast("long")
        up = (rest > half) | ((rest == half) & (low % 2 == 1))
        return (p["whole"] * 10 + low + F.when(up, 1).otherwise(0)).cast("double") / 10

    small = F.when(c < float(1 << 53), c).otherwise(0.0)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(c < float(1 << 53), let(small, rounded)).otherwise(c)


def percent_1(c: Column) -> Column:
    """A ratio as a percentage with one decimal, such as 85.0%."""
    value = F.coalesce(c, F.lit(0.0)) * 100
    shown = F.format_string("%.1f%%", round_1(F.abs(value)))
    return F.when(value < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def first_number(c: Column) -> Column:
    """The first run of digits as a long; null when there is none (or it does not fit)."""
    digits = F.regexp_extract(c, r"([0-9]+)", 1)
    return digits.try_cast("bigint")


def distinct_ignoring_case(items: Column) -> Column:
    """Drop later spellings of the same text, keeping the first one and the order.

    Sorts instead of searching, so a page with very many addresses stays n log n.
    """

    def keyed(found: Column) -> Column:
        return F.array_sort(
            F.transform(
                found, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))
            )
        )

    def firsts(rows: Column) -> Column:
        kept = F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["k"] != r["k"]))
        in_order = F.array_sort(
            F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))
        )
        return F.transform(in_order, lambda r: r["x"])

    return let(items, lambda a: F.when(F.size(a) < 2, a).otherwise(let(keyed(a), firsts)))
