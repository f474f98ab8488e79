"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all learning documents. Weights are trained follow-the-regularised-leader
with L1 and L2 penalties on a bounded sample, and a temperature is fitted on held-back sample rows.
Term frequencies are shares of a text's n-grams, so a score is one gather and a sum per text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, functions as F

from siteweave.llm.common import texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
# Learning rows that the optimizer sees, over all languages, and of each language at least.
SAMPLE_ROWS = 6000
LEAST_ROWS = 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.02
SCALE = 16.0
UNDETERMINED = "und"
# Unicode letters, as the learning rows are chosen by; other signs that count as alphanumeric are none.
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20
_FACTORS = (2654435761, 2246822519, 3266489917)


@dataclass
class Model:
    languages: list[str]
    weights: object  # BUCKETS x languages, idf included
    bias: object
    temperature: float


def ngrams(text: str):
    """Buckets of all character n-grams of the lower-cased text, in arrays of bounded size."""
    import numpy as np

    text = text.lower()
    overlap = max(ORDERS) - 1
    for at in range(0, len(text), _PIECE):
        head = at and overlap
        points = np.frombuffer(text[at - head : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = []
        for order in ORDERS:
            n = len(points) - order + 1
            if n <= 0:
                continue
            h = np.full(n, order * 40503, dtype=np.uint32)
            for k in range(order):
                h = (h ^ points[k : k + n]) * np.uint32(_FACTORS[k])
                h ^= h >> np.uint32(15)
            found.append((h >> np.uint32(16))[max(0, head - order + 1) if head else 0 :])
        if found:
            yield np.concatenate(found)


def _idf(df, n_docs: int):
    import numpy as np

    return np.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def document_frequencies(rows: DataFrame) -> tuple:
    """Documents per bucket over all rows, and their number. One row per bucket and task is moved."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        df, n, seen = np.zeros(BUCKETS, dtype=np.int64), 0, np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for t in texts(batch.column(0)):
                seen[:] = False
                for found in ngrams(t.decode()):
                    seen[found] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"]
        )

    counted = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, n_docs = np.zeros(BUCKETS), 0
    for r in counted.collect():  # at most BUCKETS + 1 rows
        if r.bucket < 0:
            n_docs = r.n
        else:
            df[r.bucket] = r.n
    return df, n_docs


def _sample(rows: DataFrame, id_column: str) -> DataFrame:
    """About SAMPLE_ROWS rows, alike for every language that occurs, drawn by a hash of the id and text.

    With so many languages that this leaves less than LEAST_ROWS for each, about so many of each.
    """
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = max(LEAST_ROWS, SAMPLE_ROWS / max(1, counts.count()))
    rates = F.broadcast(counts.select("lang", F.least(F.lit(1.0), share / F.col("n")).alias("rate")))
    drawn = F.pmod(F.xxhash64(id_column, F.octet_length("text")), F.lit(1 << 20)) / (1 << 20)
    return rows.join(rates, "lang").where(drawn < F.col("rate")).drop("rate")


def _vectors(rows: DataFrame) -> DataFrame:
    """(lang, held, buckets, shares) of the sample rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for t in texts(batch.column(2)):
                counts = np.zeros(BUCKETS, dtype=np.int64)
                for found in ngrams(t.decode()):
                    counts += np.bincount(found, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                out.append((at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([b for _, b in out], pa.list_(pa.float32()))],
                names=["lang", "draw", "buckets", "shares"],
            )

    return rows.select("lang", "draw", "text").mapInArrow(run, "lang string, draw long, buckets array<int>, shares array<float>")


def ftrl(examples: list, classes: int, epochs: int = EPOCHS):
    """Weights (BUCKETS x classes) and bias of (buckets, values, class) examples."""
    import numpy as np

    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(zs, ns):
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for at, x, y in examples:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last one is the bias
            w = current(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    for a in range(0, BUCKETS + 1, 1 << 12):  # in place, so that many classes need no further matrices
        z[a : a + (1 << 12)] = current(z[a : a + (1 << 12)], n[a : a + (1 << 12)])
    return z[:BUCKETS], z[BUCKETS]


def _temperature(logits, truth) -> float:
    """Scale that minimises the log loss of held-back rows, by golden section."""
    import numpy as np

    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

    low, high, g = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(docs: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Model of the labelled rows for which ``learn_from`` holds.

    Null languages and texts without letters teach nothing; without any learning row the model
    knows no language and calls every text undetermined.
    """
    import numpy as np

    rows = docs.where(learn_from).select(
        F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n_docs = document_frequencies(rows)
    idf = _idf(df, n_docs) * SCALE
    sample = _sample(rows, "doc_id").withColumn("draw", F.xxhash64("text", "doc_id"))
    drawn = _vectors(sample).toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])  # bounded, see _sample
    known = drawn.column("lang").to_pylist()
    languages = sorted(set(known))
    number = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0), 1.0)
    at, share = (c.combine_chunks() for c in (drawn.column("buckets"), drawn.column("shares")))
    rows_of = [(b := at[i].values.to_numpy(), share[i].values.to_numpy() * idf[b].astype(np.float32), number[lang]) for i, lang in enumerate(known)]
    # every fifth row of a language is held back, so that each language is learned
    held, learn, seen = [], [], [0] * len(languages)
    for row in rows_of:
        seen[row[2]] += 1
        (learn if seen[row[2]] % 5 else held).append(row)
    weights, bias = ftrl(learn, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held])
    heat = _temperature(logits, np.array([y for _, _, y in held]))
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, heat)


def _predictor(model: Model):
    import numpy as np

    def one(text: str) -> tuple[str, float]:
        if not model.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        total, s = 0, np.zeros(len(model.languages))
        for found in ngrams(text):
            s += model.weights.take(found, axis=0).sum(axis=0)
            total += len(found)
        s = (s / max(1, total) + model.bias) / model.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        return model.languages[best], float(p[best])

    return one


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row; ``und`` with score 0 for null texts and texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        one = _predictor(shared.value)
        for batch in batches:
            found = [one(t.decode()) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float, text_column: str = "text") -> DataFrame:
    """Rows whose language is known with a score of at least ``least``; all columns, nothing moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches):
        import pyarrow as pa

        one = _predictor(shared.value)
        for batch in batches:
            found = [one(t.decode()) for t in texts(batch.column(at))]
            keep = pa.array([lang != UNDETERMINED and p >= least for lang, p in found], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def fold(id_column: str, folds: int) -> Column:
    """Remainder of the crc32 of the id as text; null ids count as empty."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds
