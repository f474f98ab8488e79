"""SimHash near-dedup: fingerprints, multi-index hashing, components.

A fingerprint of 64 bits is cut into segments; two fingerprints within ``max_bits`` differ by at
most ``max_bits // segments`` bits in one of them. Every distinct
fingerprint is stored once per segment and asks for the values in a small Hamming ball around its
own segment; complete distances are verified on what the tables return.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from siteweave.llm.common import ASCII_LOWER, texts
from siteweave.llm.components import components, forest
from siteweave.plans.stages import written

BITS = 64
SEGMENTS = 3
# Fingerprints of one table bucket that a task holds at a time; larger buckets are dealt to several.
BLOCK = 8192
# Pairs compared at a time within a task.
PAIRS = 1 << 20


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Fingerprint of one word sequence; no words give zero."""
    import numpy as np
    import xxhash

    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends = (starts + sizes - 1)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        some = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(doc_id, fp long): one row per document; null texts count as empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # split() of bytes cuts at exactly the six ASCII spaces of the word rule
            found = [fingerprint(t.translate(ASCII_LOWER).split(), shingle) for t in texts(batch.column(1))]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def near_pairs(fps: DataFrame, max_bits: int, segments: int = SEGMENTS) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> links (a, b) that connect what is within ``max_bits``.

    Links are verified by complete distance; of the links seen in a task only a spanning forest is
    handed on, so a group of g close fingerprints yields about g rows and never all its pairs.
    """
    radius = max_bits // segments
    if radius > 1:
        raise ValueError("use more segments: balls of more than one bit are not small")
    value = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1)
    keys = [
        (value(s, w) * segments + i).alias("key") for i, (s, w) in enumerate(_segments(segments))
    ]
    stored = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    # A pair one bit apart is asked for from the side whose bit is clear.
    asked = [
        F.when(F.shiftrightunsigned("fp", s + b).bitwiseAND(1) == 0, (value(s, w) + (1 << b)) * segments + i)
        for i, (s, w) in enumerate(_segments(segments))
        for b in range(w if radius else 0)
    ]
    asking = fps.select("fp", F.explode(F.array_compact(F.array(*keys, *asked))).alias("key"))
    crowded = written(
        stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        .select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")),
        "crowded",
    )
    blocks = F.coalesce("blocks", F.lit(1))
    stored = stored.join(crowded, "key", "left").select(
        "key", F.pmod(F.xxhash64("fp"), blocks).alias("block"), F.lit(0).alias("role"), "fp"
    )
    asking = asking.join(crowded, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(1).alias("role"), "fp"
    )
    rows = (
        stored.unionByName(asking)
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "role", "fp")
        .select("key", "block", "role", "fp")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held_key = held = None
        for batch in batches:
            key, block, role, fp = (c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            group = np.cumsum(new) - 1
            table = role == 0
            tf, tg = fp[table], group[table]
            if held is not None and len(key) and (key[0], block[0]) == held_key:
                tf, tg = np.concatenate([held, tf]), np.concatenate([np.zeros(len(held), dtype=tg.dtype), tg])
            if len(key):  # what the next batch may still ask for
                held_key, held = (key[-1], block[-1]), tf[tg == group[-1]]
            qf, qg = fp[~table], group[~table]
            lo, hi = np.searchsorted(tg, qg, "left"), np.searchsorted(tg, qg, "right")
            some = hi > lo
            qf, lo, n = qf[some], lo[some], (hi - lo)[some]
            sums = np.cumsum(n)
            a, b = [], []
            at = 0
            while at < len(qf):
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
                m = n[at:to]
                q = np.repeat(qf[at:to], m)
                first = np.repeat(lo[at:to] - np.concatenate([[0], np.cumsum(m)[:-1]]), m)
                t = tf[first + np.arange(len(q))]
                near = (np.bitwise_count(q ^ t) <= max_bits) & (q != t)
                if near.any():
                    x, y = forest(q[near].view(np.int64), t[near].view(np.int64))
                    a.append(x)
                    b.append(y)
                at = to
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id): smallest doc_id reachable over links of at most ``max_bits`` bits.

    Null texts are empty, texts without words have fingerprint zero and link like others. Rows
    with a null id keep a row and take the smallest id of their component, or null if it has none;
    repeated rows are one document each. An empty table gives no rows. Other columns are ignored.
    """
    fps = written(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    # All documents of a fingerprint are linked: one row with the smallest id stands for them.
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts = components(near_pairs(classes.select("fp"), max_bits), "a", "b")
    joined = classes.join(parts, classes.fp == parts.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("part"), "first"
    )
    joined = written(joined, "parts")
    low = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    named = joined.join(low, "part").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
