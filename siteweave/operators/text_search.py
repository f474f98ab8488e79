"""Which texts contain which keys, through an index of grams instead of a comparison of all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.plans.skew import attach
from siteweave.plans.stages import written

# Longest gram. Shorter keys are grams themselves.
GRAM = 4


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, each once; a look-ahead yields them in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _key_grams(key: Column) -> Column:
    return F.when(F.length(key) <= GRAM, F.array(key)).otherwise(_grams(key, GRAM))


def containing(keys: DataFrame, texts: DataFrame, columns: list[str], hot_rows: int | None = None) -> DataFrame:
    """``(key, id)`` for every key and every text that contains it, in lower case, in one of the columns.

    ``keys`` holds distinct keys in lower case, ``texts`` one row per ``id``. Every gram that occurs in
    a key is counted over the texts, one row per gram after partial sums. A key is then looked for by
    its rarest gram only: the texts that have it are its candidates, and only these are compared with
    the whole key. A key with a gram that no text has is dropped unseen. The work of a key so follows
    its rarest gram, not its length or the number of lengths, and white space is a character like any
    other. Each text crosses the shuffle once, whatever the number of its candidates. Null texts
    contain nothing; an empty key finds nothing.
    """
    asked = written(keys.where(F.col("key") != "").select("key"), "search-keys")
    grams = asked.select("key", F.explode(_key_grams(F.col("key"))).alias("gram"))
    wanted = grams.select("gram").distinct()
    # lengths that occur among the grams: at most GRAM numbers, so short grams cost only where asked for
    sizes = asked.agg(F.collect_set(F.least(F.length("key"), F.lit(GRAM))).alias("s")).scalar()
    lowered = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    none = F.expr("cast(array() as array<string>)")
    found = [
        F.when(F.array_contains("sizes", size), F.concat(*[_grams(text, size) for text in lowered])).otherwise(none)
        for size in range(1, GRAM + 1)
    ]
    cut = texts.withColumn("sizes", sizes).select("id", F.explode(F.array_distinct(F.concat(*found))).alias("gram"))
    counts = written(cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(wanted, "gram", "left_semi"), "gram-counts")
    known = grams.join(counts, "gram", "left").groupBy("key").agg(
        F.min(F.struct("n", "gram")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("missing")
    )
    anchors = written(known.where("missing = 0").select("key", "rarest.gram", "rarest.n"), "anchors")
    anchor_counts = anchors.select("gram", "n").distinct()
    # common grams are split by their exact counts, here and below
    postings = attach(cut, anchor_counts.select("gram"), "gram", "id", "left_semi", hot_rows, counted=anchor_counts)
    candidates = attach(postings, anchors.select("gram", "key"), "gram", "id", "inner", hot_rows, counted=anchor_counts)
    contains = reduce(lambda a, b: a | b, [text.contains(F.col("key")) for text in lowered])
    return candidates.select("id", "key").join(texts.select("id", *columns), "id").where(contains).select("key", "id")
