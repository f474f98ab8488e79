"""Running totals over long ordered runs, in two levels so that no task sees a whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteweave.plans.stages import written

# Rows of a range.
CHUNK = 100_000

_RANGE = "__range"


def running_counts(
    rows: DataFrame, run: str, seq: str, flags: dict[str, Column], chunk: int = CHUNK
) -> DataFrame:
    """Add a running count per flag within each run, in ``seq`` order (unique per run).

    A prefix sum over ranges: the rows are dealt to ranges of run and ``seq`` that hold about ``chunk``
    rows each, however the values of ``seq`` lie and however long a run is. Inside a range a window
    counts; a range hands on one total per run that it holds, and the totals of earlier ranges are
    added. Range borders are drawn from a sample and kept by writing the dealt rows.
    """
    names = list(flags)
    marked = rows.withColumns({f"__{n}": F.coalesce(flag, F.lit(False)).cast("long") for n, flag in flags.items()})
    ranges = max(1, -(-rows.count() // chunk))
    dealt = marked.repartitionByRange(ranges, run, seq).withColumn(_RANGE, F.spark_partition_id())
    placed = written(dealt, "ranges")
    totals = placed.groupBy(run, _RANGE).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in names])
    earlier = Window.partitionBy(run).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(run).alias("__run"),
        F.col(_RANGE).alias("__of"),
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in names],
    )
    within = Window.partitionBy(run, _RANGE).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.withColumns({f"__{n}": F.sum(f"__{n}").over(within) for n in names})
    # rows without a run are a run of their own
    same = F.col(run).eqNullSafe(F.col("__run")) & (F.col(_RANGE) == F.col("__of"))
    return inner.join(offsets, same).select(
        *rows.columns, *[(F.col(f"__{n}") + F.col(f"__o_{n}")).alias(n) for n in names]
    )
