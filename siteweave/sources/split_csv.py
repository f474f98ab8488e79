"""CSV whose quoted fields hold line breaks, read by many tasks however large a file is."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_OPTIONS = {"escape": '"'}


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"')))


def read_split_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV files with a header, all columns text, quotes doubled; as ``read_csv`` reads them.

    Lines are read in splits. A quoted field is open after an odd number of quotes, so a line that holds
    an odd number opens or closes one, and how many such lines came before tells where a line stands:
    after an even number a record begins, and the records cut by line breaks are counted by every second
    one. Each split hands on its count, one small row; the counts of earlier splits are added. Lines that
    are whole records are parsed as they are, only the pieces of cut ones are grouped, each by its own
    record. A quote that is never closed makes the rest of its file one record, as in any CSV reader.
    ``columns`` names the columns; by default the header of the first file does.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    lines = raw.withColumn("odd", _quotes(F.col("line")) % 2)
    per_split = lines.groupBy("file", "block").agg(
        F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odds")
    )
    splits_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = per_split.select(
        "file", "block", "first_row",
        F.coalesce(F.sum("n").over(splits_before), none).alias("lines_before"),
        F.coalesce(F.sum("odds").over(splits_before), none).alias("odds_before"),
    )
    before = Window.partitionBy("file", "block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(offsets, ["file", "block"]).select(
        "file",
        (F.col("row_id") - F.col("first_row") + F.col("lines_before")).alias("line_no"),
        (F.coalesce(F.sum("odd").over(before), none) + F.col("odds_before")).alias("odds"),
        (F.col("odd") == 1).alias("odd"),
        "line",
    )
    whole = (F.col("odds") % 2 == 0) & ~F.col("odd")
    cut = placed.where(~whole).groupBy("file", F.floor(F.col("odds") / 2).alias("record")).agg(
        F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts")
    )
    joined = cut.select("file", "line_no", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"))
    records = placed.where(whole).select("file", "line_no", "line").unionByName(joined)
    records = records.withColumn("line", F.rtrim(F.col("line"), F.lit("\r")))
    if columns is None:
        header = records.where("line_no = 0").orderBy("file").select("line").first()
        columns = next(csv.reader(io.StringIO(header.line, newline=""))) if header else []
    if not columns:
        return spark.createDataFrame([], "value string").drop("value")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = records.where((F.col("line_no") > 0) & (F.trim("line") != ""))
    return rows.select(F.from_csv("line", schema, _OPTIONS).alias("r")).select("r.*")
