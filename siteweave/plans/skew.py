"""Plans that hold when one key owns a large share of the rows.

``attach`` joins many rows to a one-row-per-key table; ``first_per_key`` finds first occurrences
without collecting a key's rows anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key with more rows is spread over parts of about this many rows.
HOT_ROWS = 1_000_000
# Longest list of hot keys that is ever broadcast, some 30 MB. At 10^12 rows no more keys can be hot;
# beyond that the list keeps the hottest.
MAX_HOT_KEYS = 1_000_000

_SALT = "__salt"
_PARTS = "__parts"


def hot_keys(rows: DataFrame, key: str, hot_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """The keys of ``rows`` with very many rows and how many parts each needs.

    At most ``MAX_HOT_KEYS``, from a pre-aggregated count, or from ``counted`` (key, ``n``) where the
    counts are known.
    """
    if counted is None:
        counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = HOT_ROWS if hot_rows is None else hot_rows
    heavy = counted.where(F.col("n") >= limit).orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    return heavy.select(key, (F.ceil(F.col("n") / limit) + 1).cast("long").alias(_PARTS))


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str | Column,
    how: str = "left",
    hot_rows: int | None = None,
    salts: int | None = None,
    count_on: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (one row per key, or few) on ``key``, whatever the key distribution.

    Rows of hot keys, and rows without a key, are spread by a hash of ``spread_by`` (a column that
    differs between the rows of one key); the lookup row of a hot key is repeated once per part, and
    parts follow from the key's count (``salts`` fixes their number).
    The hot-key list is bounded by ``MAX_HOT_KEYS``, so broadcasting it is safe at any scale.
    ``count_on`` is a cheaper frame with the same key distribution, for rows that are costly to
    compute, ``counted`` (key, ``n``) are counts that are known already. A lookup that is small at run
    time is still broadcast by the optimizer.
    """
    hot = hot_keys(rows if count_on is None else count_on, key, hot_rows, counted)
    hot = F.broadcast(hot if salts is None else hot.withColumn(_PARTS, F.lit(salts).cast("long")))
    # rows without a key match nothing and may stand anywhere
    spread = F.xxhash64(spread_by)
    salt = F.when(F.col(key).isNull(), spread).when(F.col(_PARTS).isNotNull(), F.pmod(spread, F.col(_PARTS)))
    salted = (
        rows.join(hot, key, "left")
        .withColumn(_SALT, salt.otherwise(F.lit(0).cast("long")))
        .drop(_PARTS)
    )
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(_PARTS, F.lit(1)).cast("long") - 1)
    repeated = (
        lookup.join(hot, key, "left")
        .withColumn(_SALT, F.explode(every))
        .drop(_PARTS)
    )
    joined = salted.join(repeated, [key, _SALT], how).drop(_SALT)
    extra = [c for c in lookup.columns if c != key]
    if how in ("left_anti", "left_semi"):
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns])
    return joined.select(*[F.col(f"`{c}`") for c in [*rows.columns, *extra]])


def first_per_key(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Smallest ``order`` value of each key. Partial aggregation reduces a hot key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min(order).alias(order))


def mark_first(rows: DataFrame, key: str | list[str], order: str, flag: str) -> DataFrame:
    """Add ``flag``: true on the first row of each key. ``order`` must be unique over all rows.

    The join runs on the unique ``order`` column, never on the key, so no key can be hot. Rows
    without a key are never first.
    """
    firsts = first_per_key(rows, key, order).select(order, F.lit(True).alias(flag))
    return rows.join(firsts, order, "left").select(
        *rows.columns, F.coalesce(flag, F.lit(False)).alias(flag)
    )
