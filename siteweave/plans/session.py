"""Session for tests and benchmarks on one machine; on a cluster use the cluster's own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "siteweave") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
