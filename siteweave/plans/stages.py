"""Written stage tables: how a long job cuts its lineage and survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Spark fixes the setting above when a session starts; this one may be set later.
OWN_SETTING = "spark.siteweave.sharedFolder"


def _named(spark: SparkSession) -> str | None:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    return named or spark.conf.get(OWN_SETTING, None)


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for intermediate tables (``spark.checkpoint.dir``).

    A session without the setting is an error: a machine-local folder would be lost with its machine.
    """
    folder = _named(spark)
    if not folder:
        raise ValueError(f"set {SETTING} (or {OWN_SETTING}) to a folder that the driver and all executors share")
    return folder.rstrip("/")


def use_default_folder(spark: SparkSession) -> None:
    """For entry points: where the setting is missing, name a folder in the shared warehouse."""
    if not _named(spark):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.conf.set(OWN_SETTING, f"{warehouse}/siteweave-stages")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is deleted when the session's JVM ends in order."""
    text = f"{shared_folder(spark)}/siteweave/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return text


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stage table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table as parquet in the shared folder and read it back.

    Readers then scan only the columns they need and nothing upstream runs twice.
    """
    target = path or fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """Write a table in the shared folder, dealt by a hash of ``key``, for joins on that key.

    Such a join finds the rows where they lie and moves only the other side. By default there are as
    many buckets as shuffle partitions. The table's name is dropped at the end of the block, so what
    was made from it must be stored by then.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"siteweave_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    dealt.option("path", fresh_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"drop table {table}")
