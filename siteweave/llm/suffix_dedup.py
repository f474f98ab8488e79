"""Repeated windows of whole texts by depth-limited most-significant-digit passes over suffixes.

Suffixes are never ordered beyond ``WINDOW`` bytes: passes cut them into groups by one digit after
the other (a digit is a hashed run of bytes), groups of one are dropped, and what is still together
after the last pass is exactly a repeated window.

First digit. Shuffling a suffix per byte would move many times the input, so the first pass looks
at one suffix per minimizer only: of the 69 grams of 32 bytes in a window, the one with the smallest
hash. Equal windows have the same minimizer at the same place, so a window whose minimizer gram is
seen once cannot repeat.
Second digit, the 168 bytes that hold all windows of a minimizer: where they are equal, all windows
but the earliest ones are repeats. Third digit, 34 bytes to either side: a window reaches that far to
one of them, so minimizers that share neither have no repeated window. Last digit: the remaining
windows themselves, by 128 bits of hash.

Rows travel packed, some thousands to a binary value. Every task keeps only the first of equal
groups before it sends, so no group grows beyond the number of tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from siteweave.llm.common import parts_of, texts, total_bytes
from siteweave.plans.stages import written

WINDOW = 100
GRAM = 32
GRAMS = WINDOW - GRAM + 1  # grams of a window
SIDE = GRAMS - 1  # bytes that windows reach to either side of a gram
HALF = SIDE // 2
# Text per bucket and per sending, windows handled at a time and rows per sending.
BUCKET_BYTES = 12 << 20
SEND_BYTES = 8 << 20
PIECE = 1 << 17
SEND_ROWS = 1 << 18
# From so many different surroundings of a gram within one sending on, its windows are compared
# directly, everywhere.
CROWDED = 64
FULL, LEFT, RIGHT = 1, 2, 4
_END = 256  # symbol around and between texts


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Tape:
    """Texts laid side by side with hashes of every run of 1, 2, 4, ... bytes."""

    def __init__(self, symbols, seed: int = 1, depth: int = 128):
        import numpy as np

        table = _mix(np.arange(1, _END + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.runs = {1: table[symbols]}
        n = 1
        while n < depth:
            h = self.runs[n]
            twice = h.copy()
            twice *= np.uint64(0xD6E8FEB86659FD93 + 2 * n * seed)
            twice[:-n] += h[n:]
            self.runs[2 * n] = twice
            n *= 2

    def hashes(self, at, length: int):
        """Hash of the ``length`` bytes from each place on."""
        import numpy as np

        out, done = np.zeros(len(at), dtype=np.uint64), 0
        for n in sorted(self.runs, reverse=True):
            while length - done >= n:
                out = out * np.uint64(0x9FB21C651E98DF25) + self.runs[n][at + done]
                done += n
        return _mix(out)


def pieces(size: int):
    """Window starts [s0, s1) of a text in pieces, with the starts [e0, e1) that have to be seen."""
    last = size - WINDOW + 1
    for s0 in range(0, max(0, last), PIECE):
        s1 = min(last, s0 + PIECE)
        yield s0, s1, max(0, s0 - GRAMS), min(last, s1 + GRAMS)


class Anchors:
    """Minimizers of some texts: arrays text, gram place, first and last window start."""

    def __init__(self, docs: list[tuple[int, bytes]], parts: list[tuple[int, int, int, int, int]]):
        import numpy as np

        # parts: (index into docs, s0, s1, e0, e1)
        gap = np.full(SIDE, _END, dtype=np.uint16)
        tape, base, at = [gap], [], SIDE
        for d, _, _, e0, e1 in parts:
            text = docs[d][1]
            a, b = max(0, e0 - SIDE), min(len(text), e1 + WINDOW + SIDE)
            base.append(at - a)
            tape += [np.frombuffer(text, dtype=np.uint8)[a:b].astype(np.uint16), gap]
            at += b - a + SIDE
        symbols = np.concatenate(tape)
        self.tape = Tape(symbols)
        n_places = max(1, int(len(symbols) - 1).bit_length())
        places = np.arange(len(symbols), dtype=np.uint64)
        low = (_mix(self.tape.runs[GRAM].copy()) >> np.uint64(n_places)) << np.uint64(n_places) | places
        width = 1
        while 2 * width <= GRAMS:
            low[:-width] = np.minimum(low[:-width], low[width:])
            width *= 2
        low[: -(GRAMS - width)] = np.minimum(low[: -(GRAMS - width)], low[GRAMS - width :])
        sizes = np.array([e1 - e0 for *_, e0, e1 in parts], dtype=np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        first = np.array([b + p[3] for b, p in zip(base, parts)], dtype=np.int64)
        starts = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[part]
        gram = (low[starts] & np.uint64((1 << n_places) - 1)).astype(np.int64)
        new = np.ones(len(part), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
        cut = np.flatnonzero(new)
        last = np.append(cut[1:], len(part)) - 1
        base_of, part = np.array(base, dtype=np.int64)[part[cut]], part[cut]
        s_lo = starts[cut] - base_of
        s0 = np.array([p[1] for p in parts], dtype=np.int64)[part]
        s1 = np.array([p[2] for p in parts], dtype=np.int64)[part]
        own = (s_lo >= s0) & (s_lo < s1)
        self.doc = np.array([p[0] for p in parts], dtype=np.int64)[part][own]
        self.at, self.base = gram[cut][own], base_of[own]
        self.lo, self.hi = s_lo[own], (starts[last] - base_of)[own]
        self.symbols = symbols

    @property
    def place(self):
        return self.at - self.base


def anchored(docs: list[tuple[int, bytes]]):
    """Anchors of texts, some pieces at a time, so that memory is bounded for any text."""
    parts, size = [], 0
    for d, (_, text) in enumerate(docs):
        for s0, s1, e0, e1 in pieces(len(text)):
            parts.append((d, s0, s1, e0, e1))
            size += e1 - e0 + WINDOW + SIDE
            if size >= PIECE:
                yield Anchors(docs, parts)
                parts, size = [], 0
    if parts:
        yield Anchors(docs, parts)


# Columns of packed rows; a blob names its layout in the first byte.
_LAYOUTS = (
    {"h": "<u8", "ctx": "<u8", "left": "<u4", "right": "<u4", "key": "<i8", "place": "<i8", "wild": "<u1"},
    {"h": "<u8", "h2": "<u8", "key": "<i8", "start": "<i8"},
    {"key": "<i8", "place": "<i8", "code": "<u1"},
    {"key": "<i8", "start": "<i8"},
    {"key": "<i8", "size": "<i8"},
)
_STEPS = ("key", "place", "start")  # stored as differences


def _pack(arrays: dict, body: bytes = b"") -> bytes:
    """Columns one after the other, byte planes apart: what changes little compresses well."""
    import numpy as np

    number = [set(x) for x in _LAYOUTS].index(set(arrays))
    out = [bytes([number]), len(next(iter(arrays.values()))).to_bytes(4, "little")]
    for name, kind in _LAYOUTS[number].items():
        column = arrays[name].astype(kind)
        if name in _STEPS:
            column = np.diff(column, prepend=column.dtype.type(0))
        out.append(np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes())
    return b"".join([*out, body])


def _unpack(blob) -> tuple[dict, memoryview]:
    """Columns by name, and the bytes behind them."""
    import numpy as np

    view = memoryview(blob)
    n, at, out = int.from_bytes(view[1:5], "little"), 5, {}
    for name, kind in _LAYOUTS[view[0]].items():
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(view[at : at + n * wide], dtype=np.uint8).reshape(wide, n)
        column = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out[name] = np.cumsum(column) if name in _STEPS else column
        at += n * wide
    return out, view[at:]


def _joined(blobs: list[dict]) -> dict:
    import numpy as np

    return {k: np.concatenate([b[k] for b in blobs]) for k in blobs[0]}


def _bucket(keys, buckets: int):
    import numpy as np

    return (_mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(which, buckets: int, kind: int, arrays: dict) -> list[tuple[int, int, bytes]]:
    """Rows dealt to buckets: one packed (bucket, kind, blob) each."""
    import numpy as np

    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    return [
        (b, kind, _pack({k: v[order[edges[b] : edges[b + 1]]] for k, v in arrays.items()}))
        for b in range(buckets)
        if edges[b + 1] > edges[b]
    ]


def _rows(found: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary())],
        names=["bucket", "kind", "blob"],
    )


_SCHEMA = "bucket int, kind int, blob binary"


def _sendings(batches):
    """Lists of (key, text bytes) of about SEND_BYTES."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for key, text in zip(some.column(0).to_pylist(), texts(some.column(1))):
                held.append((key, text))
                size += len(text)
                if size >= SEND_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _changes(*columns):
    import numpy as np

    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _shared(h, side):
    """For rows (one per class): whether another row has the same gram and the same side."""
    import numpy as np

    order = np.lexsort((side, h))
    new = _changes(h[order], side[order])
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    out = np.empty(len(h), dtype=bool)
    out[order] = np.repeat(n > 1, n)
    return out


def _classified(rows: dict, final: bool):
    """Order, codes and which rows go on. ``final``: all rows of their grams are here."""
    import numpy as np

    order = np.lexsort((rows["place"], rows["key"], rows["ctx"], rows["h"]))
    r = {k: v[order] for k, v in rows.items()}
    new_h, new_c = _changes(r["h"]), _changes(r["h"], r["ctx"])
    code = np.where(new_c, 0, FULL).astype(np.uint8)
    group = np.cumsum(new_h) - 1
    classes = np.bincount(group, new_c).astype(np.int64)[group] if len(group) else group
    wild = np.zeros(len(code), dtype=bool)
    if final:
        any_wild = np.bincount(group, r["wild"] > 0)[group] > 0 if len(group) else wild
        firsts = new_c & (classes > 1)
        left = _shared(r["h"][firsts], r["left"][firsts])
        right = _shared(r["h"][firsts], r["right"][firsts])
        code[firsts] = left * LEFT + right * RIGHT
        code[new_c & any_wild] = LEFT | RIGHT
    else:
        wild = classes >= CROWDED
        code[new_c & wild] = LEFT | RIGHT
        wild_row = wild & new_h
        r["wild"] = wild_row.astype(np.uint8)  # one row stands for a crowded gram
        return r, code, (new_c & ~wild) | wild_row
    return r, code, None


def _codes(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed codes of minimizers by text: (bucket of the key, 0, key / place / code)."""

    def send(batches):
        import numpy as np

        for held in _sendings(batches):
            keys = np.array([k for k, _ in held], dtype=np.int64)
            found = []
            for a in anchored(held):
                found.append({
                    "h": a.tape.hashes(a.at, GRAM), "ctx": a.tape.hashes(a.at - SIDE, WINDOW + SIDE),
                    "left": a.tape.hashes(a.at - HALF, HALF).astype(np.uint32), "right": a.tape.hashes(a.at + GRAM, HALF).astype(np.uint32),
                    "key": keys[a.doc], "place": a.place.astype(np.int64),
                })
            if not found:
                continue
            r, code, go = _classified(_joined(found), final=False)
            out = []
            done = code > 0
            if done.any():
                pass_on = {k: r[k][done] for k in ("key", "place")} | {"code": code[done]}
                out += _split(_bucket(pass_on["key"], buckets), buckets, 1, pass_on)
            if go.any():
                rows = {k: v[go] for k, v in r.items()}
                # in order of place, so that keys and places compress
                order = np.lexsort((rows["place"], rows["key"]))
                rows = {k: v[order] for k, v in rows.items()}
                out += _split((rows["h"] % np.uint64(buckets)).astype(np.int64), buckets, 0, rows)
            if out:
                yield _rows(out)

    def classify(batches):
        for kind, blobs in _by_bucket(batches):
            if kind == 1:
                rows = _joined(blobs)
            else:
                r, code, _ = _classified(_joined(blobs), final=True)
                # a row that only stands for a crowded gram has its code already
                keep = (code > 0) & (r["wild"] == 0)
                rows = {"key": r["key"][keep], "place": r["place"][keep], "code": code[keep]}
            if len(rows["key"]):
                yield _rows(_split(_bucket(rows["key"], buckets), buckets, 0, rows))

    dealt = docs.mapInArrow(send, _SCHEMA).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(classify, _SCHEMA)


def _by_bucket(batches):
    """(kind, unpacked blobs) of each bucket and kind, rows being sorted by both."""
    at, held = None, []
    for batch in batches:
        for b, k, blob in zip(*(batch.column(i) for i in range(3))):
            key = (b.as_py(), k.as_py())
            if key != at and held:
                yield at[1], held
                held = []
            at = key
            held.append(_unpack(blob.as_buffer())[0])
    if held:
        yield at[1], held


def _packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, 9, blob): texts of a bucket compressed together, behind all other kinds."""

    def run(batches):
        import numpy as np
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for held in _sendings(batches):
            keys = np.array([k for k, _ in held], dtype=np.int64)
            which = _bucket(keys, buckets)
            out = []
            for b in np.unique(which):
                at = np.flatnonzero(which == b)
                body = press.compress(b"".join(held[i][1] for i in at))
                sizes = np.array([len(held[i][1]) for i in at], dtype=np.int64)
                out.append((int(b), 9, _pack({"key": keys[at], "size": sizes}, body)))
            yield _rows(out)

    return docs.mapInArrow(run, _SCHEMA)


def _texts_with(batches):
    """(known, [(key, text)]) per packed group of texts; known: kind -> joined rows of the bucket."""
    import numpy as np
    import zstandard

    press, bucket, known = zstandard.ZstdDecompressor(), None, {}
    for batch in batches:
        for b, k, blob in zip(*(batch.column(i) for i in range(3))):
            b, k = b.as_py(), k.as_py()
            if b != bucket:
                bucket, known, raw = b, {}, {}
            found, body = _unpack(blob.as_buffer())
            if k != 9:
                raw.setdefault(k, []).append(found)
                continue
            if raw:
                for kind, blobs in raw.items():
                    rows = _joined(blobs)
                    order = np.argsort(rows["key"], kind="stable")
                    known[kind] = {name: v[order] for name, v in rows.items()}
                raw = {}
            body = press.decompress(body)
            ends = np.cumsum(found["size"])
            yield known, [(key, body[e - n : e]) for key, e, n in zip(found["key"].tolist(), ends.tolist(), found["size"].tolist())]


def _of(rows: dict | None, key: int) -> dict | None:
    """Rows of one key out of rows sorted by key."""
    import numpy as np

    if rows is None:
        return None
    a, b = np.searchsorted(rows["key"], key, "left"), np.searchsorted(rows["key"], key, "right")
    return {k: v[a:b] for k, v in rows.items()} if b > a else None


def _coded(held, known):
    """(anchors, code per anchor) for texts with codes."""
    import numpy as np

    some = [(k, t, c) for k, t in held if (c := _of(known.get(0), k)) is not None]
    docs = [(k, t) for k, t, _ in some]
    if not docs:
        return
    # place and code of all, in order of (text, place)
    where = np.concatenate([np.full(len(c["place"]), i) for i, (_, _, c) in enumerate(some)])
    place = np.concatenate([c["place"] for _, _, c in some])
    code = np.concatenate([c["code"] for _, _, c in some])
    order = np.lexsort((place, where))
    where, place, code = where[order], place[order], code[order]
    spot = where.astype(np.int64) << 40 | place
    for a in anchored(docs):
        wanted = a.doc << 40 | a.place
        at = np.minimum(np.searchsorted(spot, wanted), len(spot) - 1)
        yield docs, a, np.where(spot[at] == wanted, code[at], 0)


def _repeats(packed: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, 1, key / start): windows left to compare that also start earlier."""

    def send(batches):
        import numpy as np

        def dealt(found):
            r = _joined(found)
            order = np.lexsort((r["start"], r["key"], r["h2"], r["h"]))
            r = {k: v[order] for k, v in r.items()}
            first = _changes(r["h"], r["h2"])
            out = []
            if not first.all():
                again = {k: r[k][~first] for k in ("key", "start")}
                out += _split(_bucket(again["key"], buckets), buckets, 1, again)
            r = {k: v[first] for k, v in r.items()}
            return _rows(out + _split((r["h"] % np.uint64(buckets)).astype(np.int64), buckets, 0, r))

        found, rows = [], 0
        for known, held in _texts_with(batches):
            for docs, a, code in _coded(held, known):
                need = (code & (LEFT | RIGHT)) > 0
                if not need.any():
                    continue
                place, code = a.place[need], code[need]
                # a window that starts at least HALF before the gram needs the left side, others the right
                lo = np.where(code & LEFT, a.lo[need], np.maximum(a.lo[need], place - HALF))
                hi = np.where(code & RIGHT, a.hi[need], np.minimum(a.hi[need], place - HALF))
                n = np.maximum(hi - lo + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = start + a.base[need][row]
                second = Tape(a.symbols, seed=7, depth=64)
                keys = np.array([k for k, _ in docs], dtype=np.int64)
                found.append({"h": a.tape.hashes(at, WINDOW), "h2": second.hashes(at, WINDOW), "key": keys[a.doc[need][row]], "start": start})
                rows += len(start)
                if rows >= SEND_ROWS:
                    yield dealt(found)
                    found, rows = [], 0
        if found:
            yield dealt(found)

    def compare(batches):
        import numpy as np

        for kind, blobs in _by_bucket(batches):
            r = _joined(blobs)
            if kind == 0:
                order = np.lexsort((r["start"], r["key"], r["h2"], r["h"]))
                again = ~_changes(r["h"][order], r["h2"][order])
                r = {k: r[k][order][again] for k in ("key", "start")}
            if len(r["key"]):
                yield _rows(_split(_bucket(r["key"], buckets), buckets, 1, r))

    both = packed.unionByName(codes).repartition("bucket").sortWithinPartitions("bucket", "kind")
    dealt = both.mapInArrow(send, _SCHEMA).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(compare, _SCHEMA)


def _kept(packed: DataFrame, codes: DataFrame, repeats: DataFrame, with_text: bool) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for known, held in _texts_with(batches):
            lo, hi, who = [], [], []
            number = {k: i for i, (k, _) in enumerate(held)}
            for docs, a, code in _coded(held, known):
                full = (code & FULL) > 0
                lo.append(a.lo[full])
                hi.append(a.hi[full])
                who.append(np.array([number[k] for k, _ in docs], dtype=np.int64)[a.doc[full]])
            for i, (k, _) in enumerate(held):
                if (again := _of(known.get(1), k)) is not None:
                    lo.append(again["start"])
                    hi.append(again["start"])
                    who.append(np.full(len(again["start"]), i))
            lo, hi, who = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (lo, hi, who))
            order = np.lexsort((lo, who))
            lo, hi, who = lo[order], hi[order] + WINDOW, who[order]
            edges = np.searchsorted(who, np.arange(len(held) + 1))
            out = []
            for i, (k, text) in enumerate(held):
                a, b = lo[edges[i] : edges[i + 1]], hi[edges[i] : edges[i + 1]]
                spans = 0
                kept = text
                if len(a):
                    reach = np.maximum.accumulate(b)
                    new = np.append(True, a[1:] > reach[:-1])  # touching runs are one
                    starts, ends = a[new], reach[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                    spans = len(starts)
                    cuts = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                out.append((k, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    both = packed.unionByName(codes).unionByName(repeats).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame | None]:
    """(key long, text) with keys in order of id, and (key, doc_id) unless the key is the id.

    Distinct non-null integer ids are keys as they are. Otherwise rows are numbered in order of id,
    nulls last, equal ids in order of their place in the stored table.
    """
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_column).alias("d")).first()
    if row.n == row.d and docs.schema[id_column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text")), None
    stored = written(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row")), "rows"
    )

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(n, n + batch.num_rows))], names=["row", "part", "at"]
            )
            n += batch.num_rows

    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ordered = stored.select("row", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = written(ordered.select("row").mapInArrow(number, "row long, part long, at long"), "numbers")
    sizes = {r.part: r.n for r in numbers.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return stored.select(F.col("row").alias("key"), "text"), stored.select(F.col("row").alias("key"), "doc_id")
    first = F.element_at(F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]), F.col("part"))
    keyed = written(stored.join(numbers.select("row", (first + F.col("at")).cast("long").alias("key")), "row").drop("row"), "keyed")
    return keyed.select("key", "text"), keyed.select("key", "doc_id")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]): one row per document.

    Removes every byte covered by a window of ``WINDOW`` bytes that also starts earlier: in a
    document with a smaller id, or before it in the same one. Null texts are empty. Among equal ids
    the row stored first is the earlier one, null ids come last. Texts shorter than a window stay
    whole; an empty table gives no rows; other columns are ignored.
    """
    rows, names = _numbered(docs, id_column, text_column)
    buckets = parts_of(total_bytes(docs, text_column), BUCKET_BYTES)
    codes = written(_codes(rows, buckets), "minimizers")
    repeats = written(_repeats(_packed_texts(rows, buckets), codes, buckets), "repeats")
    kept = _kept(_packed_texts(rows, buckets), codes, repeats, with_text)
    kept = kept if with_text else kept.drop("kept")
    if names is None:
        return kept.withColumn("key", F.col("key").cast(docs.schema[id_column].dataType)).withColumnRenamed("key", "doc_id")
    return names.join(kept, "key").drop("key")
