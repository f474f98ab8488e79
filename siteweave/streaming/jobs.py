"""Incremental jobs: each run takes what has arrived since the last one and stops.

A job's progress lives in its checkpoint folder; starting it again continues there. All folders
belong on storage the whole cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siteweave.functions.domains import normalize_domain
from siteweave.functions.text import strip
from siteweave.operators.crm import import_company_actions, import_contact_actions
from siteweave.plans.stages import delete
from siteweave.sources.tables import write_csv
from siteweave.streaming.history import KeyHistory

_ALONE = "__alone"


def read_arrivals(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """Stream of the files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append everything that is available to a table; each input row is written once."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.trigger(availableNow=True).start(path).awaitTermination()


def incremental_export(
    arrivals: DataFrame,
    exports: dict[str, Callable[[DataFrame], DataFrame]],
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> None:
    """Export results as they arrive, each domain once over all runs.

    ``exports`` names the export tables (companies, leads, …) and makes their rows from results. Which
    domains are done is kept in a :class:`KeyHistory`, of which a batch reads only the buckets of its
    own domains. The batch itself is read once: duplicates are reduced before the shuffle and the rest
    is stored, from where all exports are made. Every batch owns its folders
    (``<export>/batch_id=n``): a repeated batch replaces its own output.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = KeyHistory(spark, f"{path}/domains", "domain")
        # records without a domain are no duplicates of each other; they are kept apart
        alone = F.when(F.col("domain").isNull(), F.monotonically_increasing_id())
        named = batch.withColumn("domain", normalize_domain(F.col("domain"))).withColumn(_ALONE, alone)
        arrived = _stored(named.dropDuplicates(["domain", _ALONE]).drop(_ALONE), f"{path}/arrived/batch_id={batch_id}")
        arrived.where(F.col("domain").isNull()).write.mode("overwrite").parquet(f"{path}/without_domain/batch_id={batch_id}")
        fresh = arrived.where(F.col("domain").isNotNull())
        kept = fresh.join(history.known(fresh, batch_id), "domain", "left_anti")
        stage = _stored(kept.select(fresh.columns), f"{path}/results/batch_id={batch_id}")
        for name, to_rows in exports.items():
            _overwrite(to_rows(stage), f"{path}/{name}/batch_id={batch_id}", fmt)
        history.add(stage.select("domain"), batch_id)
        delete(spark, f"{path}/arrived/batch_id={batch_id}")

    _run_batches(arrivals, one_batch, checkpoint, "append")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _overwrite(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def first_domains(arrivals: DataFrame) -> DataFrame:
    """The first record of each domain. State grows with the number of domains."""
    return arrivals.dropDuplicates(["domain"])


def first_domains_within(arrivals: DataFrame, ts: str, delay: str = "24 hours") -> DataFrame:
    """The first record of each domain within a time span; older state is dropped."""
    stamped = arrivals.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["domain"])


def progress_stats(arrivals: DataFrame) -> DataFrame:
    """Running totals of arriving results, one row per status: few rows of state at any scale."""
    return arrivals.groupBy("status").agg(
        F.count(F.lit(1)).alias("records"), F.sum("leads").alias("leads")
    )


def run_stats(stats: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the newest totals in a small parquet table."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    _run_batches(stats, replace, checkpoint, "complete")


def _run_batches(
    df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str
) -> StreamingQuery:
    query = (
        df.writeStream.foreachBatch(fn)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def upsert_actions(
    arrivals: DataFrame,
    crm: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "domain",
    hot_rows: int | None = None,
) -> None:
    """Turn arriving import rows into create/update actions, batch by batch.

    ``key`` is ``domain`` for companies or ``email`` for contacts; ``crm`` holds the id and that key. A
    key created by an earlier batch is an update in a later one. Created keys are kept in a
    :class:`KeyHistory`, of which a batch reads only the buckets of its own keys, and of the CRM only
    the rows of its keys reach the join. The batch is read once. Every batch writes its own
    ``batch_id`` folder of ``actions`` and its own run of ``created``, so a repeated batch replaces its
    own output and is never counted as an earlier one.
    """
    plan = {"domain": import_company_actions, "email": import_contact_actions}[key]

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = KeyHistory(spark, f"{path}/created", "key")
        arrived = _stored(batch, f"{path}/arrived/batch_id={batch_id}")
        keys = arrived.select(strip(F.col(key)).alias("key")).distinct()
        asked = crm.select(key, "id").join(keys.withColumnRenamed("key", key), key, "left_semi")
        # once the snapshot shows the created record, its real id counts
        earlier = history.known(keys, batch_id).withColumnRenamed("key", key).join(asked, key, "left_anti")
        known = asked.unionByName(earlier.select(key, F.concat(F.lit("new:"), key).alias("id")))
        actions = _stored(plan(arrived, known, hot_rows), f"{path}/actions/batch_id={batch_id}")
        history.add(actions.where(F.col("action") == "create").select("key"), batch_id)
        delete(spark, f"{path}/arrived/batch_id={batch_id}")

    _run_batches(arrivals, one_batch, checkpoint, "append")
