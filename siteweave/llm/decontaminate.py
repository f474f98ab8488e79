"""Benchmark decontamination by winnowing, in column expressions only.

Both sides hash every ``gram`` consecutive words and keep, of every ``window - gram + 1``
consecutive hashes, the smallest. Equal windows keep the same hash, so every shared window shares
a kept hash: a join on hashes misses none. Each hit carries the few benchmark words around it; the
hit is extended over them, and what covers a whole window counts, compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.functions.text import let

WINDOW = 13
GRAM = 5
# A kept hash and its place in one number, so that a plain minimum finds both: 35 bits and 28 bits.
_PLACE = 28
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: cut at ASCII characters other than letters and digits, A-Z lower-cased."""
    lowered = lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, _UPPER, _LOWER))
    cut = F.split(F.coalesce(text, F.lit("")), _SEPARATORS)
    return F.transform(F.filter(cut, lambda w: w != ""), lowered)


def _gram_hashes(found: Column, length: int) -> Column:
    """Hash of every ``length`` consecutive words with its place (from 0); needs that many words."""
    return F.transform(
        F.sequence(F.lit(0), F.size(found) - length),
        lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(length), F.slice(found, i + 1, length)), _PLACE + 1), _PLACE)
        + i,
    )


def kept_hashes(found: Column, window: int, gram: int) -> Column:
    """Winnowed hashes with their places, each once; none for fewer words than a window."""
    span = window - gram + 1
    keep = lambda hashes: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size(hashes) - (span - 1)), lambda i: F.array_min(F.slice(hashes, i, span)))
    )
    return F.when(F.size(found) >= window, let(_gram_hashes(found, gram), keep)).otherwise(F.array().cast("array<bigint>"))


def _hash(v: Column) -> Column:
    return F.shiftrightunsigned(v, _PLACE)


def _place(v: Column) -> Column:
    return v.bitwiseAND((1 << _PLACE) - 1).cast("int")


def benchmark_hits(items: DataFrame, id_column: str, text_column: str, window: int, gram: int) -> DataFrame:
    """(fp, item_id, at, size, around): kept hashes of the items.

    ``around`` holds the words of all windows that contain the gram, ``at`` is the gram's place in
    it and ``size`` the words of a window: all of an item that is shorter than a window.
    """
    found = items.select(F.col(id_column).cast("string").alias("item_id"), words(F.col(text_column)).alias("w"))
    reach = window - gram
    long = (
        found.where(F.size("w") >= window)
        .select("item_id", "w", F.explode(kept_hashes(F.col("w"), window, gram)).alias("v"))
        .withColumn("first", F.greatest(_place(F.col("v")) - reach, F.lit(0)))
        .select(
            _hash(F.col("v")).alias("fp"), "item_id", (_place(F.col("v")) - F.col("first")).alias("at"), F.lit(window).alias("size"),
            F.slice("w", F.col("first") + 1, _place(F.col("v")) + window - F.col("first")).alias("around"),
        )
    )
    short = found.where(F.size("w").between(1, window - 1)).select(
        F.shiftrightunsigned(F.xxhash64(F.size("w"), "w"), _PLACE + 1).alias("fp"),
        "item_id", F.lit(0).alias("at"), F.size("w").alias("size"), F.col("w").alias("around"),
    )
    return long.unionByName(short).where("item_id is not null").distinct()


def _document_hashes(found: Column, window: int, gram: int, short_sizes: list[int]) -> Column:
    """Kept hashes, and for items shorter than a window every gram of exactly their size."""
    parts = [kept_hashes(found, window, gram)]
    for size in short_sizes:
        parts.append(F.when(F.size(found) >= size, _gram_hashes(found, size)).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts)


def _windows(found: Column, groups: Column, window: int) -> Column:
    """Per gram and benchmark context: the item and the whole windows that hits extend to.

    A window is one number, ``start * (window + 1) + size``, so that repeats drop out by hashing.
    """

    def extended(context: Column, place: Column) -> Column:
        # place of a window's first word among the words around the gram
        firsts = F.sequence(F.lit(0), F.size(context["around"]) - context["size"])
        begin = lambda a: place - context["at"] + a
        same = lambda a: (begin(a) >= 0) & (
            F.slice(found, F.greatest(begin(a), F.lit(0)) + 1, context["size"]) == F.slice(context["around"], a + 1, context["size"])
        )
        return F.transform(F.filter(firsts, same), lambda a: begin(a).cast("long") * (window + 1) + context["size"])

    def of_context(g: Column, context: Column) -> Column:
        spans = F.array_distinct(F.flatten(F.transform(g["places"], lambda p: extended(context, p))))
        return F.struct(context["item_id"].alias("item_id"), spans.alias("spans"))

    all_of = F.flatten(F.transform(groups, lambda g: F.transform(g["contexts"], lambda c: of_context(g, c))))
    return F.filter(all_of, lambda x: F.size(x["spans"]) > 0)


def _n_covered(spans: Column, window: int) -> Column:
    """Words in the union of windows: in order of start, each adds what lies behind those before."""
    begin = lambda x: F.floor(x / (window + 1)).cast("long")
    end = lambda x: begin(x) + x % (window + 1)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(end(x) - F.greatest(begin(x), s["to"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(s["to"], end(x)).alias("to"),
    )
    return F.aggregate(F.array_sort(F.array_distinct(spans)), start, step)["n"]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    only_hit: bool = False,
) -> DataFrame:
    """(doc_id, text, n_words, n_hit, items): one row per document, with ``only_hit`` of candidates alone.

    ``n_hit`` counts words inside any occurrence of a window of an item, ``items`` lists the items
    (ids as text, sorted) with occurring windows. An item with fewer words than a window, but not
    none, is one window. Null texts have no words, null item ids and items without words never
    occur. Rows with equal id and text get equal results; empty tables give no rows or no hits.
    Other columns are ignored.
    """
    wanted = benchmark_hits(items, item_id_column, item_text_column, window, gram)
    # At most ``window - 1`` numbers.
    short_sizes = sorted(r[0] for r in wanted.where(F.col("size") < window).select("size").distinct().collect())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    key = F.xxhash64("text")
    hashes = rows.where("text is not null").select(
        "doc_id", key.alias("key"), F.explode(let(words(F.col("text")), lambda w: _document_hashes(w, window, gram, short_sizes))).alias("v")
    )
    # Rows are few from here on: only hashes that a benchmark item keeps go further, and the
    # optimizer broadcasts the items when their size allows it.
    contexts = wanted.groupBy("fp").agg(F.collect_list(F.struct("item_id", "at", "size", "around")).alias("contexts"))
    hits = (
        hashes.select("doc_id", "key", _hash(F.col("v")).alias("fp"), _place(F.col("v")).alias("place"))
        .join(contexts.select("fp"), "fp", "left_semi")
        .groupBy("doc_id", "key", "fp")
        .agg(F.collect_set("place").alias("places"))
        .join(contexts, "fp")
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("places", "contexts")).alias("hits"))
    )
    joined = rows.withColumn("key", key).join(
        hits.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "hits"),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")),
        "inner" if only_hit else "left",
    )
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _SEPARATORS), lambda w: w != "")).cast("long")

    def result(windows: Column) -> Column:
        return F.struct(
            _n_covered(F.flatten(F.transform(windows, lambda w: w["spans"])), window).alias("n_hit"),
            F.array_sort(F.array_distinct(F.transform(windows, lambda w: w["item_id"]))).alias("items"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = F.when(
        F.col("hits").isNotNull(), let(words(F.col("text")), lambda w: let(_windows(w, F.col("hits"), window), result))
    ).otherwise(nothing)
    out = joined.select("doc_id", "text", n_words.alias("n_words"), found.alias("found"))
    return out.select("doc_id", "text", "n_words", "found.n_hit", "found.items")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
