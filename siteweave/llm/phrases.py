"""Phrase mining: Apriori-safe candidates counted by double-array tries over coded text.

Text is cut into words once and written as blocks of codes. A run of k words is looked at if its
parts of k - 1 words are all frequent. The runs of the text are dealt to shards by a hash, alike ones
of a part of the text as one, so the text is read once for each k, however many candidates there are.
A shard's candidates are the runs whose place in a table of hashed counts is full enough; they become
double-array tries, and numpy moves the states of all runs of the shard through them at once, one
level a step. Accepting states are binned, which gives the exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from siteweave.llm.common import ASCII_LOWER, grouped, parts_of, texts
from siteweave.plans.skew import attach
from siteweave.plans.stages import delete, fresh_path, written

# Candidates of one trie, which bounds what a task holds: some 20 bytes a candidate and level.
SHARD = 300_000
# Words of the text for one shard of runs, and runs of the text that are brought together before they are dealt.
RUNS = 1_000_000
TOGETHER = 1_000_000
# The filter that tells which runs are frequent has at least eight bits for each of them, and so many at most
# (2 to the power): with more phrases it lets more runs pass, never fewer.
_FILTER_BITS = 28
_PRIME = 1_000_003
# Parts of a language that are ranked apart first; at most as many times ``top`` rows of it are left.
_PARTS = 16
# Text is coded in blocks of about this many bytes.
BLOCK = 1 << 20
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
# Each separator becomes a word of its own; it cannot occur inside a word.
_END = b"."
_TABLE = ASCII_LOWER.translate(bytes.maketrans(SEPARATORS, _END * len(SEPARATORS)))


def coded_text(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Blocks ``(block, lang, words, counts, codes)``: distinct words, their counts, and the text as codes.

    ``codes`` are little-endian 32-bit numbers into ``words``, -1 between pieces. Blocks end where
    pieces end, so every phrase stands in one block.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([
            ("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())),
            ("counts", pa.list_(pa.int64())), ("codes", pa.binary()),
        ])

        def block(language: str, parts: list[bytes]) -> pa.RecordBatch:
            words = b"\n".join(parts).translate(_TABLE).replace(_END, b" . ").split()
            coded = pa.array(words, pa.binary()).dictionary_encode()
            known, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if _END in known:
                # the separator leaves the words; later words move up
                at = known.index(_END)
                codes = np.where(codes == at, -1, codes - (codes > at))
                del known[at]
            counts = np.bincount(codes[codes >= 0], minlength=len(known))
            return pa.RecordBatch.from_pydict({
                "block": [number], "lang": [language], "words": [known], "counts": [counts],
                "codes": [codes.astype("<i4").tobytes()],
            }, schema=schema)

        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for part in _cut(value):
                    held.setdefault(language, []).append(part)
                    sizes[language] = sizes.get(language, 0) + len(part) + 1
                    if sizes[language] >= BLOCK:
                        yield block(language, held.pop(language))
                        number += 1
                        sizes[language] = 0
            if sum(sizes.values()) >= 4 * BLOCK:
                # many languages: none may fill a block for long
                for language in list(held):
                    yield block(language, held.pop(language))
                    number += 1
                sizes.clear()
        for language in list(held):
            yield block(language, held.pop(language))
            number += 1

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return named.mapInArrow(run, "block long, lang string, words array<binary>, counts array<long>, codes binary")


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where pieces end."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        ends = [e for e in (text.find(s, at + BLOCK) for s in (b".", b"\n", b",", b"!", b"?", b";", b":")) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


def _frequent_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, word, f, blocks, w1)`` of the words with at least ``least`` occurrences, and ``(lang, n)``."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counted = each.groupBy("lang", F.col("x.words").alias("word")).agg(
        F.sum("x.counts").alias("f"), F.count(F.lit(1)).alias("blocks")
    )
    kept = written(counted, "word-counts")
    totals = kept.groupBy("lang").agg(F.sum("f").alias("n"))
    # ids are fixed by being written; then the numbers of a part follow those of the parts before it
    known = kept.where(F.col("f") >= least).select("lang", "word", "f", "blocks", F.monotonically_increasing_id().alias("w1"))
    known = written(known, "words")
    part = F.shiftright("w1", 33).cast("int")
    sizes = {r.part: r.n for r in known.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]).tolist()
    dense = F.element_at(F.lit(before), part + 1) + F.col("w1").bitwiseAND((1 << 33) - 1)
    return known.withColumn("w1", dense.cast("long")), totals


def _with_ids(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks ``(codes, n_words, at, ids)``: ``ids`` are those of the frequent words among the codes, ``at`` their codes."""
    each = blocks.select("block", "lang", F.posexplode("words").alias("code", "word"))
    # a word stands in a block once, so only blocks make a key large; those keys are split by count
    # one binary key, whose first bytes order it without a look at the row; no word holds a tab
    key = F.concat(F.col("word"), F.lit(b"\t"), F.col("lang").cast("binary")).alias("key")
    keyed = each.select("block", "code", key)
    ids = known.select(key, F.col("w1"))
    counted = known.select(key, F.col("blocks").alias("n"))
    found = attach(keyed, ids, "key", "block", how="inner", counted=counted)
    # sorted by block alone, which needs no comparison of rows; a block's codes stand anywhere among its ids
    front = blocks.select("block", F.lit(-1).alias("code"), F.size("words").cast("long").alias("w1"), "codes")
    rows = front.unionByName(found.select("block", "code", "w1", F.lit(None).cast("binary").alias("codes")))
    dealt = rows.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("codes", pa.binary()), ("n_words", pa.int32()), ("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
        now, head, at, ids = None, None, [], []

        def block() -> pa.RecordBatch:
            codes, n_words = head
            return pa.RecordBatch.from_pydict(
                {"codes": [codes], "n_words": [n_words], "at": [np.concatenate(at)], "ids": [np.concatenate(ids)]}, schema=schema
            )

        for batch in batches:
            number, code, w1 = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.diff(number, prepend=number[:1])) if len(number) else []
            for begin, end in zip([0, *starts], [*starts, len(number)], strict=True):
                if begin == end:
                    continue
                if number[begin] != now:
                    if head and at:
                        yield block()
                    now, head, at, ids = number[begin], None, [], []
                own = code[begin:end] >= 0
                for front in begin + np.flatnonzero(~own):
                    head = (batch.column(3)[int(front)].as_py(), int(w1[front]))
                if own.any():
                    at.append(code[begin:end][own])
                    ids.append(w1[begin:end][own])
        if head and at:
            yield block()

    return dealt.mapInArrow(run, "codes binary, n_words int, at array<int>, ids array<long>")


@dataclass
class Trie:
    """A double array: state s goes on with symbol c to t = base[s] + c if check[t] == s."""

    symbols: np.ndarray  # sorted word ids; a symbol is a position in it
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray  # the phrase that ends in a state, -1 for none
    phrases: np.ndarray  # word ids, one row a phrase
    depth: int


def build_trie(phrases: np.ndarray) -> Trie:
    """The double array of phrases of equal length (distinct rows of word ids).

    States of a level are placed together, those with most children first: each tries a place, the
    ones whose places are free and not wanted by an earlier one stay, the others try again.
    """
    order = np.lexsort(phrases.T[::-1])
    phrases = np.ascontiguousarray(phrases[order])
    symbols, coded = np.unique(phrases, return_inverse=True)
    coded = coded.reshape(phrases.shape)
    n, depth = phrases.shape
    size = max(1024, 1 << math.ceil(math.log2(3 * (n * depth + len(symbols) + 2))))
    base, check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    leaf = np.full(size, -1, dtype=np.int32)
    check[0] = 0  # the root stands at place 0, which is nobody's child
    random = np.random.default_rng(7)
    state = np.zeros(n, dtype=np.int64)  # the state each phrase has reached
    for level in range(depth):
        symbol = coded[:, level]
        new = np.ones(n, dtype=bool)
        new[1:] = (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])
        edge_of = np.cumsum(new) - 1
        owner, child = state[new], symbol[new]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        degree = np.diff(np.r_[starts, len(owner)])
        target = np.zeros(len(owner), dtype=np.int64)
        for d in np.unique(degree)[::-1]:
            waiting = starts[degree == d]
            misses = 0
            while len(waiting):
                edges = waiting[:, None] + np.arange(d)
                kids = child[edges]
                # few at a time while they are large, so that they do not all want the same places
                some = max(1, min(len(waiting), size // (8 * int(d))))
                edges, kids = edges[:some], kids[:some]
                low, span = kids[:, 0], kids[:, -1] - kids[:, 0]
                place = 1 + (random.random(some) * (size - 1 - span)).astype(np.int64) - low
                places = place[:, None] + kids
                free = (check[places] < 0).all(axis=1)
                flat, first = np.unique(places[free], return_index=True)
                mine = np.zeros(free.sum() * d, dtype=bool)
                mine[first] = True
                good = np.flatnonzero(free)[mine.reshape(-1, d).all(axis=1)]
                if len(good):
                    slots, parents = places[good], owner[waiting[good]]
                    check[slots] = parents[:, None]
                    base[parents] = place[good]
                    target[edges[good]] = slots
                    waiting = np.delete(waiting, good)
                else:
                    misses += 1
                    if misses > 200 or some == 1 and misses > 20:
                        # too crowded: more room at the end, where everything is free
                        base, check, leaf = (np.concatenate([a, np.full(size, v, dtype=a.dtype)]) for a, v in ((base, 0), (check, -1), (leaf, -1)))
                        size *= 2
                        misses = 0
        state = target[edge_of]
    leaf[state] = np.arange(n)
    return Trie(symbols, base, check, leaf, phrases, depth)


def _symbols(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """The symbol of each word id, -1 where the trie has none."""
    at = np.minimum(np.searchsorted(trie.symbols, ids), len(trie.symbols) - 1)
    return np.where(trie.symbols[at] == ids, at, -1)


def matches(trie: Trie, symbols: np.ndarray, every: int = 1) -> np.ndarray:
    """For each position, or each so-many-th, the phrase that starts there, -1 for none: all states advance level by level."""
    at = every * np.flatnonzero(symbols[: max(0, len(symbols) - trie.depth + 1) : every] >= 0)
    state = np.zeros(len(at), dtype=np.int64)
    for level in range(trie.depth):
        symbol = symbols[at + level]
        to = trie.base[state].astype(np.int64) + symbol
        good = (symbol >= 0) & (to > 0) & (to < len(trie.check))
        good &= trie.check[np.where(good, to, 0)] == state
        at, state = at[good], to[good]
    out = np.full(-(-len(symbols) // every), -1, dtype=np.int32)
    out[at // every] = trie.leaf[state]
    return out


def _read_blocks(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of each block and the word id of each code, with -1 for rare words and, at the end, for the border between pieces."""
    codes, n_words, at, ids = batch.columns
    for row in range(batch.num_rows):
        known = np.full(n_words[row].as_py() + 1, -1, dtype=np.int64)
        known[at[row].values.to_numpy()] = ids[row].values.to_numpy()
        yield np.frombuffer(codes[row].as_buffer(), dtype="<i4"), known


def _names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _place(ids: list, bits: int) -> object:
    """The bit of a phrase in the filter; the same for columns of Spark and arrays of numpy."""
    return sum((w % _PRIME) * (7919 * i + 31) for i, w in enumerate(ids, 1)) % (1 << bits)


def _filter(phrases: DataFrame, k: int) -> np.ndarray:
    """A bit for each place that a phrase of k words falls on, eight to a byte, lowest first; bitmaps of fixed size come back."""
    bits = min(_FILTER_BITS, max(16, (8 * phrases.count()).bit_length()))
    # buckets are numbered from 1, positions in them from 0, for numbers from 1
    place = phrases.select((_place([F.col(c) for c in _names(k)], bits) + 1).alias("p"))
    maps = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in maps.collect():
        out[(r.b - 1) * len(r.bits) : r.b * len(r.bits)] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _starts(text: np.ndarray, k: int, may: np.ndarray | None) -> np.ndarray:
    """Where a run of k words starts whose words, and parts of k - 1 words, are frequent (``may`` is the filter of the parts)."""
    good = text >= 0
    if may is not None:
        n = max(0, len(text) - k + 2)
        parts = [text[i : n + i] for i in range(k - 1)]
        place = np.asarray(_place(parts, len(may).bit_length() + 2), dtype=np.int64)
        inside = np.logical_and.reduce([p >= 0 for p in parts])
        good = inside & ((may[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
    return np.flatnonzero(good[:-1] & good[1:])


def _mixed(runs: np.ndarray) -> np.ndarray:
    """A hash of each run, 64 bits."""
    out = np.zeros(len(runs), dtype=np.uint64)
    for words in runs.T:
        out = (out ^ words.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _alike(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs in the order of their hashes, the hashes, and how often each occurs."""
    mixed = _mixed(runs)
    order = np.argsort(mixed)
    hashes, rows = mixed[order], runs[order]
    differ = (rows[1:] != rows[:-1]).any(axis=1)
    if (differ & (hashes[1:] == hashes[:-1])).any():
        # several runs with one hash need not stand together
        order = np.lexsort((*runs.T, mixed))
        hashes, rows = mixed[order], runs[order]
        differ = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(np.r_[np.ones(min(1, len(rows)), dtype=bool), differ])
    return rows[starts], hashes[starts], np.diff(np.r_[starts, len(rows)])


def _dealt(coded: DataFrame, k: int, kind: str, shards: int, may: Broadcast) -> DataFrame:
    """Runs of k words that may be frequent, by shard: ``(shard, runs, counts)``, the numbers of many runs in each row.

    A run stands in the shard that its hash names, with its occurrences in a part of the text, so a
    frequent one has few rows. ``runs`` are word ids of type ``kind``, ``counts`` 32-bit numbers.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            values = np.ascontiguousarray(values)
            at = (ends * (values.nbytes // len(values))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])

        def deal() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            for begin in range(0, len(every), TOGETHER):
                runs, mixed, n = _alike(every[begin : begin + TOGETHER])
                # shards are ranges of hashes
                shard = (mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                first = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
                ends = np.r_[first, len(runs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first].astype(np.int32)), packed(runs, ends), packed(n.astype("<i4"), ends)], names=["shard", "runs", "counts"]
                )

        held, size = [], 0
        for batch in batches:
            for codes, ids in _read_blocks(batch):
                text = ids[codes]
                at = _starts(text, k, may.value)
                held.append(np.column_stack([text[at + i] for i in range(k)]).astype(kind))
                size += len(at)
                if size >= TOGETHER:
                    yield from deal()
                    held, size = [], 0
        if size:
            yield from deal()

    return coded.mapInArrow(run, "shard int, runs binary, counts binary").repartition(shards, "shard").sortWithinPartitions("shard")


def _count(runs: np.ndarray, n: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs of a shard that occur ``least`` times, and their counts: those of one trie of at most ``most`` candidates at a time.

    Equal runs may stand apart; ``n`` is how often each occurs.
    """
    k = runs.shape[1]
    # a run cannot be frequent unless its place in a table of counts is
    place = _mixed(runs) & np.uint64((1 << (2 * len(runs)).bit_length()) - 1)
    full = np.bincount(place.astype(np.int64), weights=n)[place] >= least
    runs, n = runs[full], n[full]
    candidates = _alike(runs)[0]
    for begin in range(0, len(candidates), most):
        trie = build_trie(candidates[begin : begin + most])
        found = matches(trie, _symbols(trie, runs.ravel()), every=k)
        hit = found >= 0
        total = np.bincount(found[hit], weights=n[hit], minlength=len(trie.phrases)).astype(np.int64)
        often = np.flatnonzero(total >= least)
        if len(often):
            yield trie.phrases[often], total[often]


def _counted(coded: DataFrame, k: int, kind: str, shards: int, least: int, may: np.ndarray | None) -> DataFrame:
    """Exact counts ``(w1 .. wk, a)`` of the runs of k words that occur ``least`` times."""
    names = [*_names(k), "a"]
    shipped = coded.sparkSession.sparkContext.broadcast(may)
    dealt = _dealt(coded, k, kind, shards, shipped)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for piece in grouped(batches, "shard"):
            shard = piece.column("shard").to_numpy()
            ends = np.r_[np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)]
            for begin, end in zip(ends[:-1], ends[1:], strict=True):
                runs, n = (
                    np.concatenate([np.frombuffer(v.as_buffer(), dtype=t) for v in piece.column(c)[begin:end]]) for c, t in (("runs", kind), ("counts", "<i4"))
                )
                for phrases, a in _count(runs.reshape(-1, k), n, least, SHARD):
                    yield pa.RecordBatch.from_arrays([*(pa.array(w.astype(np.int64)) for w in phrases.T), pa.array(a)], names=names)

    out = written(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names)), f"counts{k}")
    shipped.destroy()
    return out


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact whole numbers; at most 1000000, because a <= l and a <= r."""
    big = [x.cast("decimal(18,0)") for x in (a, l, r)]
    return F.call_function("div", big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)"), big[1] * big[2]).cast("long")


def _scored(counts: dict[int, DataFrame], k: int) -> DataFrame:
    """Phrases of k words with their lowest-scoring cut: ``(w1 .. wk, a, l, r, score)``."""
    rows = counts[k]
    for cut in range(1, k):
        for side, first, size in (("l", 1, cut), ("r", cut + 1, k - cut)):
            part = [F.col(f"w{first + i}").alias(f"w{i + 1}") for i in range(size)]
            # a single word is its own key: numbers sort faster than structs of one
            key = (lambda names: F.struct(*names)) if size > 1 else (lambda names: names[0])
            known = counts[size].select(key([F.col(c) for c in _names(size)]).alias("part"), F.col("a").alias(f"{side}{cut}"))
            keyed = rows.withColumn("part", key(part))
            # hot parts are counted on the written table, so the plan grows by one join a time
            hot = counts[k].select(key(part).alias("part"))
            rows = attach(keyed, known, "part", F.struct(*_names(k)), how="inner", count_on=hot).drop("part")
    cuts = [
        F.struct(_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))
        for c in range(1, k)
    ]
    best = F.array_min(F.array(*cuts))
    return rows.select(*_names(k), "a", best.alias("best")).select(*_names(k), "a", "best.l", "best.r", "best.score")


def _inside(counts: dict[int, DataFrame], k: int) -> DataFrame | None:
    """For phrases of k words the count of their most frequent longer phrase: ``(part, most)``."""
    parts = None
    for m in (m for m in counts if m > k):
        runs = [F.struct(*[F.col(f"w{i + j}").alias(f"w{j}") for j in range(1, k + 1)]) for i in range(m - k + 1)]
        one = counts[m].select(F.explode(F.array(*runs)).alias("part"), "a")
        parts = one if parts is None else parts.unionByName(one)
    return None if parts is None else parts.groupBy("part").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, least: int = 10, words: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Phrases have 2 to ``words`` words and at least ``least`` occurrences. One that lies in a longer
    phrase with at least ``share`` percent of its occurrences is left out. Ranked by score, then
    occurrences, both falling, then the phrase's bytes, so ties have one order. A null text is empty,
    a null language is ``und``, repeated rows count as often as they occur, texts of any length are
    read whole, other columns are ignored, and an empty table, or one without frequent phrases, gives
    no rows. Exact for counts below 10^15 (products are decimals of 38 digits).
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "blocks")
    blocks = written(coded_text(docs), "blocks", path)
    known, totals = _frequent_words(blocks, least)
    coded_path = fresh_path(spark, "coded")
    coded = written(_with_ids(blocks, known), "coded", coded_path)
    delete(spark, path)
    counts = {1: known.select("w1", F.col("f").alias("a"))}
    shards = parts_of(int(totals.agg(F.sum("n")).first()[0] or 0), RUNS)
    kind = "<i4" if known.count() < 1 << 31 else "<i8"
    for k in range(2, words + 1):
        may = _filter(counts[k - 1], k - 1) if k > 2 else None
        counts[k] = _counted(coded, k, kind, shards, least, may)
    delete(spark, coded_path)
    rows = None
    spell = known.select("w1", "lang", "word")
    for k in range(2, words + 1):
        own, around = _scored(counts, k), _inside(counts, k)
        if around is not None:
            keyed = own.withColumn("part", F.struct(*_names(k)))
            joined = keyed.join(around, "part", "left")
            own = joined.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("part", "most")
        for i in range(1, k + 1):
            named = spell.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"s{i}"), *(["lang"] if i == 1 else []))
            own = attach(own, named, f"w{i}", F.struct(*_names(k)), how="inner", count_on=counts[k])
        phrase = F.concat_ws(" ", *[F.decode(F.col(f"s{i}"), "UTF-8") for i in range(1, k + 1)]).alias("phrase")
        own = own.select("lang", phrase, "a", "l", "r", "score")
        rows = own if rows is None else rows.unionByName(own)
    rows = written(rows, "scored")
    # in two steps, so that no language meets in one task before its rows are few
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
