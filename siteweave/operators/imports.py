"""A CSV import from its file to its result row, whatever state the source is in."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave.operators.crm import import_company_actions, import_contact_actions
from siteweave.operators.reports import import_summary
from siteweave.plans.stages import written
from siteweave.sources.tables import non_empty_rows, read_csv

_KINDS = {"companies": (import_company_actions, "domain"), "contacts": (import_contact_actions, "email")}
RESULT = (
    "status string, object_type string, reason string, error string, total long, imported long, updated long, failed long"
)


def _marker(spark: SparkSession, status: str, object_type: str, reason: str | None = None, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(status, object_type, reason, error, None, None, None, None)], RESULT)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def run_import(spark: SparkSession, path: str, object_type: str, crm: DataFrame, connected: bool = True) -> DataFrame:
    """Result row of an import: counts when it ran, or what kept it from running.

    Without a CRM connection it is ``skipped`` (``no_token``). A kind of object that is not known, a
    source that does not exist and one that cannot be read are an ``error`` with a text. A source
    without any record is ``completed`` with zeros. Rows are numbered as they are read.
    """
    if not connected:
        return _marker(spark, "skipped", object_type, reason="no_token")
    if object_type not in _KINDS:
        return _marker(spark, "error", object_type, error=f"Unsupported object type: {object_type}")
    if not exists(spark, path):
        return _marker(spark, "error", object_type, error="source does not exist")
    plan, key = _KINDS[object_type]
    try:
        rows = read_csv(spark, path)
        if key not in rows.columns:
            # an empty file has no columns, and a file of something else not this one
            empty = not rows.columns or rows.isEmpty()
            rows = None
        else:
            numbered = non_empty_rows(rows.drop("seq")).withColumn("seq", F.monotonically_increasing_id())
            rows = written(numbered, "import-rows")
    except (PySparkException, Py4JJavaError) as e:
        return _marker(spark, "error", object_type, error=f"source cannot be read: {type(e).__name__}")
    if rows is None:
        if empty:
            return spark.createDataFrame([("completed", object_type, None, None, 0, 0, 0, 0)], RESULT)
        return _marker(spark, "error", object_type, error=f"source has no column {key}")
    counted = import_summary(rows, plan(rows, crm), object_type)
    none = F.lit(None).cast("string")
    return counted.select(
        "status", "object_type", none.alias("reason"), none.alias("error"), "total", "imported", "updated", "failed"
    )
