"""Toxicity: exact nearest labelled examples by TF-IDF cosine, votes weighted by distance.

Every word of a bounded sample of labelled rows is a term; document frequencies cover all
documents. A word of no example counts in the length of a text with the largest idf, that of a word
no document has. Examples with equal vectors are one entry with counts. The most common terms are
kept as dense columns as well, all others only as posting lists, which are read whole: nearly every
block of entries shares words with a text, so bounds per block skip too little to pay. Some block's
best entries set a bar, and only what reaches it is ordered, so the result is exact. The lists travel,
the columns are made from them where they are used. A neighbour's vote weighs the more the nearer it
is and the better the words that it shares
tell the labels apart (likelihood ratio). Held-back examples calibrate the votes.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from siteweave.llm.common import texts

# Labelled rows that are learned from, at most.
EXAMPLES = 20_000
NEIGHBOURS = 100
# Words whose likelihood ratio is lower could differ between the labels by chance (one in a thousand would).
TELLING = 10.83
BLOCK = 256
FIRST_BLOCKS = 4
# Terms kept as dense columns, the ones with most postings.
DENSE = 512
# Texts whose dense scores are computed at a time.
TOGETHER = 64
EVIDENCE = 3
# Text whose distinct words are looked up together; what is held meanwhile is some ten times as large.
TOGETHER_BYTES = 4 << 20
_WORD = re.compile(r"[^\W\d_]+")
# ASCII letters in lower case, the bytes of other characters as they are, all else a space.
_APART = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_SIGMA = "Σ".encode()


@dataclass
class Model:
    words: bytes  # the terms in order, joined by line ends
    idf: np.ndarray  # of the terms
    unseen: float  # idf of words of no example
    index: "Index"
    steps: list  # calibration: (vote from which on, probability)
    empty: float  # probability of texts that share no word with an example


@lru_cache(maxsize=1)
def numbered(words: bytes) -> dict[str, int]:
    """The place of each word; kept between the tasks of a Python worker, not to be changed."""
    return {w: i for i, w in enumerate(words.decode().split("\n"))} if words else {}


def vector(counts: dict[str, int], number: dict[str, int], idf, unseen: float) -> tuple:
    """TF-IDF of a text's words with damped counts, length one: (terms in order, weights) of its known words."""
    term = np.fromiter(map(number.get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
    return _weighed(term, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), idf, unseen)


def _weighed(term: np.ndarray, n: np.ndarray, idf, unseen: float) -> tuple:
    """As ``vector``, of the terms of a text's distinct words (-1: none) and how often they occur."""
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    known = known[np.argsort(term[known])]
    terms = term[known]
    raw = (1 + np.log(n[known])) * idf[terms]
    others = sum((1 + math.log(c)) ** 2 for c in n[term < 0].tolist())
    return terms, raw / math.sqrt(float(raw @ raw) + others * unseen * unseen)


def _apart(text: bytes) -> bytes:
    """A UTF-8 text whose ASCII letters are lower-case; other ASCII characters are spaces."""
    if _SIGMA in text:  # its lower case depends on what is around it
        text = " ".join(_WORD.findall(text.decode().lower())).encode()
    return text.translate(_APART)


@dataclass
class Counts:
    """Distinct words (runs of letters in lower case) of some texts, and for each text which of them it has how often."""

    words: list[str]
    place: np.ndarray  # in words, text after text
    n: np.ndarray
    starts: list[int]  # of each text's places; one more for the end

    def terms(self, number: dict[str, int]) -> np.ndarray:
        """The term of each place, -1 without one."""
        return np.fromiter(map(number.get, self.words, repeat(-1)), dtype=np.int64, count=len(self.words))[self.place]


def word_counts(texts: list[bytes]) -> Counts:
    """Texts are cut at ASCII characters that are no letters; of the strings between them, those with other
    characters may hold any number of words. Each distinct string is looked at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    strings = pc.split_pattern(pa.array(list(map(_apart, texts)), pa.large_string()), " ")
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(strings).to_numpy())
    coded = strings.flatten().dictionary_encode()
    number: dict[str, int] = {}
    one, several = np.full(len(coded.dictionary), -1, dtype=np.int64), {}
    for i, w in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist()):
        found = _WORD.findall(w.lower()) if not w.isascii() else (w,) if w else ()
        if len(found) == 1:
            one[i] = number.setdefault(found[0], len(number))
        elif found:
            several[i] = [number.setdefault(x, len(number)) for x in found]
    at = coded.indices.to_numpy()
    place = one[at]
    if several:
        many = np.zeros(len(one), dtype=bool)
        many[list(several)] = True
        more = [(t, p) for t, i in zip(text[many[at]].tolist(), at[many[at]].tolist()) for p in several[i]]
        extra = np.array(more, dtype=np.int64).T
        text, place = np.append(text, extra[0]), np.append(place, extra[1])
    keys, n = np.unique((text * len(number) + place)[place >= 0], return_counts=True)
    text, place = np.divmod(keys, max(1, len(number)))
    return Counts(list(number), place, n, np.searchsorted(text, np.arange(len(texts) + 1)).tolist())


def _together(values: list[bytes]):
    """Lists of texts that pass ``TOGETHER_BYTES`` by at most one text."""
    held, some = 0, []
    for t in values:
        some.append(t)
        held += len(t)
        if held >= TOGETHER_BYTES:
            yield some
            held, some = 0, []
    if some:
        yield some


class Index:
    """Inverted index over distinct vectors with (positive, all) counts and ids.

    ``vectors`` are (terms, weights) pairs, ``labels`` and ``ids`` belong to them; empty vectors are left out.
    ``telling`` says per term how much it counts in a vote.
    """

    def __init__(self, vectors: list, labels: list[int], ids: list, n_terms: int):
        merged: dict[tuple, list] = {}
        for at, ((terms, weights), y, i) in enumerate(zip(vectors, labels, ids, strict=True)):
            if len(terms):
                digest = hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest()
                # entries with the same strongest term stand together, so that few blocks have high bounds
                e = merged.setdefault((int(terms[np.argmax(weights)]), digest), [at, 0, 0, []])
                e[1], e[2] = e[1] + y, e[2] + 1
                e[3].append(i)
        entries = [merged[k] for k in sorted(merged)]
        self.positive = np.array([e[1] for e in entries], dtype=np.int64)
        self.all = np.array([e[2] for e in entries], dtype=np.int64)
        self.ids = [sorted(e[3], key=lambda i: (i is None, i))[:EVIDENCE] for e in entries]
        self.size, self.blocks = len(entries), -(-len(entries) // BLOCK)
        sizes = np.array([len(vectors[e[0]][0]) for e in entries], dtype=np.int64)
        entry = np.repeat(np.arange(len(entries), dtype=np.int32), sizes)
        # filled in place: the driver holds one copy of all postings at a time
        term, weight = np.zeros(len(entry), dtype=np.int32), np.zeros(len(entry), dtype=np.float32)
        for e, end in zip(entries, np.cumsum(sizes), strict=True):
            terms, weights = vectors[e[0]]
            term[end - len(terms) : end], weight[end - len(terms) : end] = terms, weights
        counts = np.zeros((2, n_terms), dtype=np.int64)
        for (terms, _), y in zip(vectors, labels, strict=True):
            counts[y][terms] += 1
        ratio = _likelihood_ratio(counts[1], counts[0], sum(labels), len(labels) - sum(labels))
        self.telling = np.where(ratio >= TELLING, ratio, 0).astype(np.float32)
        order = np.argsort(term, kind="stable")
        # the rarest type that holds a place: most of what travels
        self.posting = entry[order].astype(np.min_scalar_type(max(1, self.size)))
        del entry
        self.weight = weight[order]
        del weight, order
        self.list_start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        del term
        self._make_columns()

    def _make_columns(self):
        """The lists of the most common terms as dense columns."""
        sizes = np.diff(self.list_start)
        common = np.argsort(-sizes, kind="stable")[:DENSE]
        self.column = np.full(len(sizes), -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), dtype=np.float32)
        for row, a, b in zip(self.dense, self.list_start[common], self.list_start[common + 1], strict=True):
            row[self.posting[a:b]] = self.weight[a:b]

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("column", "dense")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._make_columns()

    def _lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the lists of some terms add to the cosine of a query with each entry."""
        if not len(terms):
            return np.zeros(self.blocks * BLOCK)
        first = self.list_start[terms]
        n = self.list_start[terms + 1] - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.posting[at], self.weight[at] * np.repeat(weights, n), self.blocks * BLOCK)

    def dense_scores(self, queries: list) -> np.ndarray:
        """What the common terms add to the cosine of each query (row) with each entry."""
        q = np.zeros((len(queries), len(self.dense)), dtype=np.float32)
        for row, (terms, weights) in zip(q, queries, strict=True):
            common = self.column[terms] >= 0
            row[self.column[terms[common]]] = weights[common]
        return q @ self.dense

    def nearest(self, query: tuple, k: int, dense: np.ndarray | None = None):
        """(entries, cosines) until at least k examples are counted, ties at the end included.

        Best first, equal cosines in order of entry. Only entries that share a term are found.
        """
        terms, weights = query
        if not len(terms) or not self.size:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        base = self.dense_scores([query])[0] if dense is None else dense
        rare = self.column[terms] < 0
        scores = self._lists(terms[rare], weights[rare].astype(np.float32)) + base
        # the blocks with the best entries set the bar
        blocks = scores.reshape(self.blocks, BLOCK)
        some = np.sort(blocks[np.argsort(-blocks.max(axis=1), kind="stable")[:FIRST_BLOCKS]].ravel())[::-1][:k]
        # k entries hold k examples or more
        bar = max(float(some[-1]), 0.0) if len(some) == k else 0.0
        hit = np.flatnonzero((scores > 0) & (scores >= bar))
        hit = hit[np.lexsort((hit, -scores[hit]))]
        reached = np.cumsum(self.all[hit])
        least = scores[hit[np.searchsorted(reached, k)]] if len(hit) and reached[-1] >= k else 0.0
        hit = hit[scores[hit] >= least - 1e-9]
        return hit, scores[hit]

    def shared(self, query: tuple, entries: np.ndarray) -> np.ndarray:
        """What the telling terms add to the cosine of a query with each of some entries, times how telling they are."""
        terms, weights = query
        some = self.telling[terms] > 0
        terms, weights = terms[some], weights[some] * self.telling[terms[some]]
        common = self.column[terms] >= 0
        out = weights[common] @ self.dense[np.ix_(self.column[terms[common]], entries)]
        return out + self._lists(terms[~common], weights[~common])[entries]

    def votes(self, queries: list, k: int) -> list[tuple[float | None, list]]:
        """For each query the weighted share of positive among the nearest examples, and ids.

        An example weighs 1 / (distance + 0.1), times the square of how telling the words are that it shares.
        """
        out: list = []
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            for query, dense in zip(some, self.dense_scores(some), strict=True):
                at, s = self.nearest(query, k, dense)
                if not len(at):
                    out.append((None, []))
                    continue
                weight = (1 + self.shared(query, at) / s) ** 2 / (0.1 + 1 - s.clip(0, 1))
                share = float((weight * self.positive[at]).sum() / (weight * self.all[at]).sum())
                out.append((share, [i for e in at[:EVIDENCE] for i in self.ids[e]][:EVIDENCE]))
        return out


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """G statistic of terms in a of n_a positive and b of n_b negative rows."""
    out, total = np.zeros(len(a)), n_a + n_b
    for seen, row in ((a, n_a), (b, n_b)):
        for value, column in ((seen, a + b), (row - seen, total - a - b)):
            some = value > 0
            out[some] += 2 * value[some] * np.log(value[some] * total / (row * column[some]))
    return out.clip(0)


def example_terms(examples: DataFrame) -> bytes:
    """All words of the examples in order, joined by line ends; bounded by the examples."""

    def run(batches):
        import pyarrow as pa

        words: set[str] = set()
        for batch in batches:
            for some in _together(texts(batch.column(0))):
                words.update(word_counts(some).words)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], names=["term"])

    found = examples.select("text").mapInArrow(run, "term string").distinct().toArrow()
    return "\n".join(sorted(found.column(0).to_pylist())).encode()


def document_frequencies(docs: DataFrame, words: bytes, text_column: str) -> tuple:
    """Documents per term over all documents, and their number; at most one row per term and task."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        number = numbered(shipped.value)
        df, n = np.zeros(len(number) + 1, dtype=np.int64), 0
        for batch in batches:
            for some in _together(texts(batch.column(0))):
                n += len(some)
                terms = word_counts(some).terms(number)
                df += np.bincount(terms[terms >= 0], minlength=len(df))
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    counted = docs.select(text_column).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((words.count(b"\n") + 1 if words else 0) + 1)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return df[:-1], df[-1]


def _monotone(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Isotonic steps of (vote, label): pools neighbours that would fall, smoothed by half a row."""
    pools: list[list[float]] = []
    for vote, y in sorted(points):
        if pools and pools[-1][0] == vote:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([vote, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y2, n2 = pools.pop()
            pools[-1][1] += y2
            pools[-1][2] += n2
    return [(v, (y + 0.5) / (n + 1)) for v, y, n in pools]


def _calibrated(steps: list, vote: float) -> float:
    import bisect

    if not steps:
        return vote
    at = bisect.bisect_right(steps, (vote, 2.0)) - 1
    return steps[max(at, 0)][1]


def _example_vectors(rows, idf) -> list:
    """(terms, weights) of an Arrow table with lists of terms, in order, and their counts."""
    terms, n = (rows.column(c).combine_chunks() for c in ("terms", "n"))
    flat, count = terms.flatten().to_numpy(), n.flatten().to_numpy()
    ends = np.cumsum(terms.value_lengths().to_numpy()) if len(terms) else np.zeros(0, dtype=np.int64)
    raw = ((1 + np.log(count, dtype=np.float32)) * idf[flat]).astype(np.float32)
    out = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, strict=True) if len(ends) else ():
        w = raw[a:b]
        if b > a:
            w /= math.sqrt(float(w.astype(np.float64) @ w))
        out.append((flat[a:b], w))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Model of the labelled rows (``labels``: id, 0/1 label) for which ``learn_from`` holds.

    Labels that are null, neither 0 nor 1, or without document teach nothing; of contradicting
    labels of one id 1 wins, and of the rows of one id the smallest text is the example. Without both
    labels every score is the share of positive examples.
    """
    known = labels.where(learn_from & F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).cast("int").alias("toxic"))
    rate = EXAMPLES / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(rate * (1 << 24)))
    # Bounded by EXAMPLES (up to the spread of a hash draw), so no text is moved to meet its label.
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    examples = source.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    words = example_terms(examples)
    df, n_docs = document_frequencies(docs, words, text_column)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    unseen = math.log(1 + n_docs) + 1
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def counted(batches):
        import pyarrow as pa

        number = numbered(shipped.value)
        for batch in batches:
            found = []
            for some in _together(texts(batch.column(2))):
                counts = word_counts(some)
                terms = counts.terms(number)
                found += [sorted(zip(terms[a:b].tolist(), counts.n[a:b].tolist())) for a, b in pairwise(counts.starts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "toxic", "terms", "n"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = examples.select("doc_id", "toxic", "text").mapInArrow(counted, f"doc_id {kind}, toxic int, terms array<int>, n array<int>").toArrow().sort_by("doc_id")
    ys, ids = rows.column("toxic").to_pylist(), rows.column("doc_id").to_pylist()
    vectors = _example_vectors(rows, idf.astype(np.float32))
    del rows
    # every fourth in order of a hash of the id calibrates
    drawn = sorted(range(len(ids)), key=lambda i: hashlib.blake2b(repr(ids[i]).encode(), digest_size=8).digest())
    asked, taught = drawn[::4], [i for k, i in enumerate(drawn) if k % 4]
    index = Index([vectors[i] for i in taught], [ys[i] for i in taught], [ids[i] for i in taught], len(df))
    votes = index.votes([vectors[i] for i in asked], NEIGHBOURS)
    steps = _monotone([(v, ys[i]) for i, (v, _) in zip(asked, votes, strict=True) if v is not None])
    blank = [y for (terms, _), y in zip(vectors, ys, strict=True) if not len(terms)]
    share = (sum(ys) + 0.5) / (len(ys) + 1)
    return Model(words, idf, unseen, index, steps, (sum(blank) + share) / (len(blank) + 1))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence): one row per document, ids of near examples as evidence.

    Texts that share no word with any example, null and empty ones included, share the calibrated
    probability of such texts. Texts of any length are read whole. Repeated rows and null ids return
    as they are, equal texts with equal scores; neighbours of equal cosine all vote. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m, known = shared.value, {}
        number = numbered(m.words)
        for batch in batches:
            values = texts(batch.column(1))
            keys = [hashlib.blake2b(t, digest_size=16).digest() for t in values]
            if len(known) > 20_000:
                known.clear()
            new = {k: t for k, t in zip(keys, values, strict=True) if k not in known}
            new_keys = iter(new)
            for some in _together(list(new.values())):
                counts = word_counts(some)
                terms = counts.terms(number)
                queries = [_weighed(terms[a:b], counts.n[a:b], m.idf, m.unseen) for a, b in pairwise(counts.starts)]
                for vote, ids in m.index.votes(queries, NEIGHBOURS):
                    known[next(new_keys)] = (m.empty if vote is None else _calibrated(m.steps, vote), ids)
            found = [known[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()),
                    pa.array([i for _, i in found], pa.list_(batch.column(0).type)),
                ],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<{kind}>")
