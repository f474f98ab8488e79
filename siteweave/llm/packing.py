"""Lexical retrieval packing.

Document frequencies and mean length cover all documents. Documents are ordered by their most
telling terms, the widest first, so those that share them stand together wherever they come from; a
term that a third of all documents share is split by the next ones. The order is cut into shards of
bounded size, which the tasks of a range partitioning read one after the other: the work grows in
proportion to the corpus, and no task or driver holds a list of documents or shards. In a shard an
inverted BM25 index is asked with the whole document that opens a window and returns its unused
neighbours, best first, and they fill the window greedily. The document that crosses the end of a
window is cut there, and its rest opens the next one. So every window but the last of a shard is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave.llm.common import parts_of, total_bytes
from siteweave.llm.tokens import REMEMBERED, encoder
from siteweave.plans.stages import written

# Text of a shard. The index of a shard and its search are some ten times as large.
SHARD_BYTES = 3 << 19
# Text of a task, which packs its shards one after the other; more where there would be too many tasks.
TASK_BYTES = 16 << 20
MAX_TASKS = 1 << 17
# Sampled documents for each task, whose order gives the borders between tasks.
SPLITTERS = 32
# Least numbers of documents that have the first, second and last telling term of a document.
WIDTHS = (1 << 12, 1 << 7, 2)
# Bytes of token ids in a batch on the way to the stage table.
_BATCH_BYTES = 4 << 20
# Rows whose token ids a task has as Python values at a time.
_ROWS = 500
K1, B = 1.2, 0.75


@dataclass
class Corpus:
    """Documents, their mean length and, per token id, the documents that have it."""

    n: int
    mean: float
    df: object

    def __post_init__(self):
        import numpy as np

        self.idfs = np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))

    def idf(self, terms):
        return self.idfs[terms]

    def weights(self, tokens):
        """Distinct token ids of a document and their BM25 weights."""
        import numpy as np

        terms, tf = np.unique(tokens, return_counts=True)
        return terms, self.idf(terms) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / self.mean))

    def telling(self, tokens) -> list[int]:
        """The heaviest term of a document among those of each width; without one its most frequent term."""
        import numpy as np

        terms, weight = self.weights(tokens)
        df = self.df[terms]
        out = []
        for width in WIDTHS:
            wide = np.flatnonzero(df >= width)
            out.append(int(terms[wide[np.argmax(weight[wide])]] if len(wide) else terms[np.argmax(df)]))
        return out


class Index:
    """Inverted BM25 index over token ids of the documents of one shard.

    Frequencies are those of the corpus, or without one those of the documents themselves.
    """

    def __init__(self, docs: list, corpus: Corpus | None = None):
        import numpy as np

        self.np = np
        counted = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in counted], dtype=np.int64)
        term = np.concatenate([t for t, _ in counted]) if docs else np.zeros(0, dtype=np.uint32)
        tf = np.concatenate([c for _, c in counted]) if docs else np.zeros(0)
        doc = np.repeat(np.arange(len(docs)), sizes)
        length = np.array([len(d) for d in docs], dtype=np.float64)
        mean = corpus.mean if corpus else max(1.0, float(length.mean())) if docs else 1.0
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, df = np.unique(term, return_counts=True)
        idf = corpus.idf(self.terms) if corpus else np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        self.column = np.searchsorted(self.terms, term)
        weight = idf[self.column] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(self.column, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.posting_start = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused):
        """Unused documents that share a term with the seed, best first, ties in order."""
        np = self.np
        terms = self.column[self.starts[seed] : self.starts[seed + 1]]
        first, n = self.posting_start[terms], self.posting_start[terms + 1] - self.posting_start[terms]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.posting_doc[at], self.posting_weight[at], len(unused))
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list, window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Token arrays -> (document, start, length, sequence, offset); sequences numbered from 0."""
    import numpy as np

    index, unused = Index(docs, corpus), np.ones(len(docs), dtype=bool)
    pieces, sequence, filled, next_unused = [], 0, 0, 0
    ranking, at, current, done = np.zeros(0, dtype=np.int64), 0, -1, 0
    while True:
        if current < 0:  # the best unused neighbour of the seed, or else the next unused document
            while at < len(ranking) and not unused[ranking[at]]:
                at += 1
            if at < len(ranking):
                current = int(ranking[at])
            else:
                while next_unused < len(docs) and not unused[next_unused]:
                    next_unused += 1
                if next_unused == len(docs):
                    return pieces
                current = next_unused
                unused[current] = False
                if len(docs[current]) < window - filled:
                    ranking, at = index.neighbours(current, unused), 0
            unused[current], done = False, 0
        take = min(len(docs[current]) - done, window - filled)
        pieces.append((current, done, take, sequence, filled))
        done, filled = done + take, filled + take
        rest = len(docs[current]) - done
        if filled == window:
            sequence, filled = sequence + 1, 0
            ranking, at = np.zeros(0, dtype=np.int64), 0
            if 0 < rest < window:  # the rest is the seed of the window that it opens
                ranking = index.neighbours(current, unused)
        if not rest:
            current = -1


def _stored(ids: bytes) -> bytes:
    """Four bytes an id -> two; where one needs more, all four and a byte behind them all.

    A batch of rows is held several times on its way between Spark and Python.
    """
    import numpy as np

    wide = np.frombuffer(ids, dtype="<u4")
    return ids + b"\0" if len(wide) and wide.max() >> 16 else wide.astype("<u2").tobytes()


def _tokens(value: bytes):
    """Token ids of a stored document."""
    import numpy as np

    return np.frombuffer(value, dtype="<u4", count=len(value) // 4) if len(value) % 2 else np.frombuffer(value, dtype="<u2")


def _some_rows(batches):
    """Arrow batches -> pieces of few rows, whose Python values are held together."""
    for batch in batches:
        yield from (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS))


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs of the block send at most so many rows to Python at a time; without a number as the session says."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _corpus(encoded: DataFrame) -> Corpus:
    """One pass over all documents; at most one row per token id and task is moved."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        df, n, total = np.zeros(1, dtype=np.int64), 0, 0
        for batch in _some_rows(batches):
            for value in batch.column(0).to_pylist():
                ids = _tokens(value)
                found = np.unique(ids)
                if len(found) and found[-1] >= len(df):
                    df = np.append(df, np.zeros(2 * int(found[-1]) + 1 - len(df), dtype=np.int64))
                df[found] += 1
                n, total = n + 1, total + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [n, total]]))], names=["term", "n"]
        )

    found = {r.term: r.n for r in encoded.select("tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-1, 0) or 0, found.pop(-2, 0) or 0
    df = np.zeros(max(found, default=0) + 1)
    df[list(found)] = list(found.values())
    return Corpus(n, max(1.0, total / max(1, n)), df)


def _ordered(encoded: DataFrame, corpus, tasks: int) -> DataFrame:
    """Rows with their telling terms, in that order over ``tasks`` parts of about the same size.

    The borders come from a sample of bounded size, so that terms are weighed once and for few rows again.
    """
    spark = encoded.sparkSession
    names = [f"t{i}" for i in range(len(WIDTHS))]

    def told(batch):
        """Telling terms of the rows of a batch, which has key and tokens."""
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "tokens"))
        return [(*corpus.value.telling(_tokens(v)), key) for key, v in zip(*columns, strict=True)]

    def sampled(batches):
        import pyarrow as pa

        for batch in _some_rows(batches):
            rows = [pa.array([r[i] for r in told(batch)], pa.int64()) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*rows, batch.column(batch.schema.get_field_index("size"))], names=[*names, "key", "size"])

    draw = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 40))
    share = min(1.0, SPLITTERS * tasks / max(1, corpus.value.n))
    kinds = ", ".join(f"{n} long" for n in [*names, "key", "size"])
    rows = encoded.where(draw < int(share * (1 << 40))).select("key", "size", "tokens").mapInArrow(sampled, kinds).toArrow() if tasks > 1 else None
    borders: list[tuple] = []
    if rows is not None and rows.num_rows:
        ordered = sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))
        held, total = 0, sum(r[-1] + 1 for r in ordered)
        for r in ordered:
            held += r[-1] + 1
            if held * tasks >= total * (len(borders) + 1) and len(borders) < tasks - 1:
                borders.append(r[:-1])
    shipped = spark.sparkContext.broadcast(borders)

    def run(batches):
        import pyarrow as pa
        from bisect import bisect_left

        known = shipped.value
        for batch in _some_rows(batches):
            rows = told(batch)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            part = pa.array([bisect_left(known, r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, part], names=[*batch.schema.names, *names, "part"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    found = encoded.mapInArrow(run, kinds + "".join(f", {n} long" for n in names) + ", part int")
    # equal rows are equal in all of these
    return found.repartitionById(tasks, F.col("part")).sortWithinPartitions(*names, "key", "doc_id")


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    window: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_bytes: int = SHARD_BYTES,
    remembered: int = REMEMBERED,
    batch_rows: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null and empty texts hold the end id alone. Rows are documents of their own, repeated or not, null
    ids included. Texts of any length are cut freely; one above ``shard_bytes`` ends its shard. Equal
    scores go by the order of the telling terms, then a hash of the row. An empty table gives no rows;
    other columns are ignored, whatever their names. ``remembered`` bounds the words whose ids a Python
    worker keeps, ``batch_rows`` the documents that are sent to one at a time while ids are made and
    counted (by default as the session says); they change memory and time, not the result.
    """
    import numpy as np

    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    tasks = min(MAX_TASKS, parts_of(total_bytes(docs, text_column), TASK_BYTES))

    def encode(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encode, end = encoder(vocabulary, remembered).encode_column, int(end_id).to_bytes(4, "little")

        def batch_of(rows, types):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "doc_id", "size", "tokens"])

        for batch in batches:
            types, rows, held = [pa.int64(), batch.column(1).type, pa.int64(), pa.binary()], [], 0
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for key, i, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size, encode(batch.column(2))):
                rows.append((key, i, n, _stored(ids + end)))
                held += len(rows[-1][3])
                if held >= _BATCH_BYTES:
                    yield batch_of(rows, types)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, types)
            pa.default_memory_pool().release_unused()

    # The key is a row's place in every order, so that a task that runs again packs the same
    # sequences. Rows with equal keys are equal, up to collisions, which do no harm.
    key = F.xxhash64(F.col(id_column).isNull(), id_column, F.col(text_column).isNull(), text_column)
    encoded = docs.select(key.alias("key"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    with _batches_of(spark, batch_rows):
        encoded = written(encoded.mapInArrow(encode, f"key long, doc_id {kind}, size long, tokens binary"), "encoded")
        shared = spark.sparkContext.broadcast(_corpus(encoded))
        ordered = _ordered(encoded, shared, tasks)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, held, ids, tokens = TaskContext.get().partitionId() << 13, 0, [], []

        def packed():
            docs = list(map(_tokens, tokens))
            found = pack_shard(docs, window, shared.value)
            cut = [docs[d][s : s + n].astype("<u4") for d, s, n, _, _ in found]
            d, start, length, seq, offset = np.array(found, dtype=np.int64).T
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(cut).view("<i4"))
            )
            whole = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in d.tolist()], schema_id), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(whole[d]),
                    pa.array(seq + (shard << 32)), pa.array(offset), lists,
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in _some_rows(batches):
            schema_id = batch.column(0).type
            for i, n, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                tokens.append(t)
                held += n + 1
                if held >= shard_bytes:
                    yield packed()
                    shard, held, ids, tokens = shard + 1, 0, [], []
        if tokens:
            yield packed()

    return ordered.select("doc_id", "size", "tokens").mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>",
    )
