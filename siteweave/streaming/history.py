"""What earlier batches of a stream have done, as a table of keys that a batch reads in part.

Keys lie in folders by a hash of the key, so a batch reads only the buckets that its own keys fall
into. Every batch adds a run of its own; ten runs of one size are merged into one of the next, like
the digits of a counter. Before batch n there are therefore at most nine runs for each digit of n,
whatever the number of earlier batches, and every key is rewritten once per digit. The names of the
runs follow from n alone: a batch that is repeated replaces its own runs and reads those of earlier
batches, never its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteweave.plans.stages import delete

# Runs of one size that are merged into one.
BASE = 10
# Folders by hash of the key. More suit longer histories; a history keeps the number it began with.
BUCKETS = 64

_BUCKET = "bucket"


def runs_before(batch_id: int) -> list[tuple[int, int]]:
    """First and last batch of the runs that hold batches 0 to ``batch_id - 1``, oldest first."""
    out, at, size = [], 0, 1
    while size * BASE <= batch_id:
        size *= BASE
    while at < batch_id:
        while at + size > batch_id:
            size //= BASE
        out.append((at, at + size - 1))
        at += size
    return out


def merges_after(batch_id: int) -> list[tuple[int, int]]:
    """The larger runs that batch ``batch_id`` completes, smallest first."""
    out, size = [], BASE
    while (batch_id + 1) % size == 0:
        out.append((batch_id + 1 - size, batch_id))
        size *= BASE
    return out


class KeyHistory:
    """Rows of ``schema`` under ``path``, one per key of all batches (``key`` is a string column)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema or f"{key} string"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame | None:
        """Rows of some runs with their bucket. Runs without rows have no files, but a schema."""
        if not runs:
            return None
        reader = self.spark.read.schema(f"{self.schema}, {_BUCKET} int")
        parts = [reader.option("basePath", self._folder(r)).parquet(self._folder(r)) for r in runs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        dealt = rows.repartition(self.buckets, _BUCKET)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._folder(run))

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Rows of earlier batches whose key is among ``keys``; other buckets are not read.

        ``keys`` should be a stored table: its bucket numbers (at most ``buckets``) are fetched first.
        """
        rows = self._read(runs_before(batch_id))
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        asked = keys.select(self.key).distinct()
        touched = sorted(r.b for r in asked.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect())
        return rows.where(F.col(_BUCKET).isin(touched)).drop(_BUCKET).join(asked, self.key, "left_semi")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write the run of a batch, and the merged runs that it completes.

        Runs that an earlier batch has merged go now: that batch is over and is not repeated.
        """
        for first, last in merges_after(batch_id - 1) if batch_id else ():
            size = (last - first + 1) // BASE
            for at in range(first, last + 1, size):
                delete(self.spark, self._folder((at, at + size - 1)))
        self._write(rows.withColumn(_BUCKET, self._bucket(F.col(self.key))), (batch_id, batch_id))
        for first, last in merges_after(batch_id):
            size = (last - first + 1) // BASE
            self._write(self._read([(at, at + size - 1) for at in range(first, last + 1, size)]), (first, last))

    def table(self, batches: int) -> DataFrame:
        """All rows of the first ``batches`` batches."""
        rows = self._read(runs_before(batches))
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.drop(_BUCKET)
