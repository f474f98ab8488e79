"""Token ids of a corpus as Parquet list columns.

One file per range of ids, documents in ascending order, ids dictionary-encoded (16 bits or less per
id for the public vocabularies), row groups and pages of a set size, page indexes as Spark's writer
makes them. Readers fetch only what they select: lengths and offsets without any ids, or the pages
of a doc_id range.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siteweave.llm.common import texts
from siteweave.llm.tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
ROWS_PER_PAGE = 2000
_OPTIONS = {
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": ROWS_PER_PAGE,
    "parquet.enable.dictionary": "true",
    # version 2 pages: what outgrows its dictionary is delta-encoded
    "parquet.writer.version": "PARQUET_2_0",
}


def token_rows(docs: DataFrame, vocabulary: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, part int, part_start long, n_tokens long, ids array<int>) in order of id.

    ``part`` numbers the output files in order, ``part_start`` counts the ids before a document in
    its file. Equal ids are ordered by text, null ids come first.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(vocabulary).encode, int(end_id).to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            found = [encode(t.decode()) + end for t in texts(batch.column(1))]
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(before + offsets[:-1]), pa.array(n), ids],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    # Ranges are drawn and sorted before tokens are made, so every text is encoded once.
    ordered = docs.select(id_column, text_column).repartitionByRange(id_column).sortWithinPartitions(id_column, text_column)
    return ordered.mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode every whole text, append ``end_id`` and write the files to ``path``.

    Null and empty texts hold the end id alone; an empty table gives files without rows. Other
    columns are ignored.
    """
    rows = token_rows(docs, vocabulary, end_id, id_column, text_column)
    rows.write.mode("overwrite").options(**_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: ids of all documents before each one.

    The sum over files reads two narrow columns and has one row per file: no more rows than the
    partitions of the write.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit numbers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8)
            at = (ids.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            n = pa.array([(b - a) // 4 for a, b in zip(at[:-1], at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )
