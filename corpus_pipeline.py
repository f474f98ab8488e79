"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All stages but the
last return the columns of ``documents``. Between stages the table is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave.llm import decontaminate, langid, packing, pii, simhash, tokens
from siteweave.plans.stages import use_default_folder, written

# Documents whose best language is less likely than this are rejected, and those without letters.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach stay.

    Null texts, texts without letters and texts whose best language is less likely than
    ``LEAST_SCORE`` go. Repeated rows, null ids and further columns stay as they are; texts are read
    whole. An empty table, or one without languages to learn from, gives no rows.
    """
    model = langid.fit(docs, langid.fold("doc_id", 3) != 1)
    return langid.accepted(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Rows are judged by their own text: of the rows of a group that share its smallest id one stays,
    the smallest by all columns, and a row of that id in another group is judged there. Documents
    without an id cannot be told apart and stay. Null and empty texts are one group. An empty table
    stays empty; further columns are kept.
    """
    use_default_folder(spark)
    groups = written(simhash.near_duplicates(docs, shingle=4, max_bits=4), "groups").where("doc_id is not null")
    # Narrow: one row per id that goes, or that stands in several rows.
    per_id = groups.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("goes")
    )
    several = written(per_id.where("n > 1 or goes"), "judged")
    rest = docs.join(several, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.join(several.where("n > 1"), "doc_id", "left_semi").select(docs.columns)
    # the rows of a repeated id are told apart by their fingerprints
    rows = repeated.select(F.struct(*repeated.columns).alias("row"), "text")
    named = simhash.fingerprints(rows, "row", "text", 4).select(F.col("doc_id").alias("row"), "fp", F.col("doc_id.doc_id").alias("doc_id"))
    own = groups.join(several.where("n > 1"), "doc_id", "left_semi").select("doc_id", "fp", "component_id").distinct()
    first = named.join(own, ["doc_id", "fp"]).where("doc_id = component_id")
    kept = first.groupBy("component_id").agg(F.min("row").alias("row"))
    return rest.unionByName(kept.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window stay.

    Null and empty texts have no words and stay. Rows are judged by their own id and text, null ids
    included, so repeated rows go or stay together. Without benchmark items all rows stay; further
    columns are kept.
    """
    use_default_folder(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items, only_hit=True)
    bad = found.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = written(bad.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"])
    return docs.join(bad, same, "left_anti").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, n_chars follows.

    A null text stays null and keeps its n_chars. Repeated rows, null ids and further columns stay;
    texts are read whole. An empty table stays empty.
    """
    out = pii.redact(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n_chars))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, with its token ids.

    Null and empty texts hold the end id alone. Every row is a document of its own, repeated or
    without id or not. An empty table gives no rows; further columns are ignored.
    """
    # by now the executors' heaps have grown: a smaller word memory and smaller batches leave room for them
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"), end_id=1, window=2048, remembered=80_000, batch_rows=1000)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

# Trained models, fingerprints and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    use_default_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
