import hashlib
import random

import numpy as np

from siteweave.llm import suffix_dedup


def brute(rows, window=100):
    """Every window in order of id and start; null ids last."""
    seen, out = set(), []
    for i, text in rows:
        t = (text or "").encode()
        covered = bytearray(len(t))
        for s in range(len(t) - window + 1):
            x = t[s : s + window]
            if x in seen:
                covered[s : s + window] = b"\1" * window
            seen.add(x)
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(c and (not j or not covered[j - 1]) for j, c in enumerate(covered))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    rows = suffix_dedup.remove_repeats(df).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def made_up(seed: int):
    random.seed(seed)
    word = lambda: "".join(random.choice("abé") for _ in range(random.randint(1, 9)))
    pool = [" ".join(word() for _ in range(random.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(100):
        parts = []
        for _ in range(random.randint(0, 6)):
            p = random.choice(pool) if random.random() < 0.6 else " ".join(word() for _ in range(30))
            k = random.randrange(len(p))
            parts.append((p[:k] + "X" + p[k:])[random.randrange(len(p) // 2) :] if random.random() < 0.5 else p)
        rows.append((i * 7 - 50, "".join(parts)))
    return rows + [(1003, "a" * 5000), (1004, "ab" * 700), (1005, "a" * 99), (1006, "a" * 100), (1007, "zx" * 60)]


def test_against_every_window(spark):
    rows = made_up(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == sorted(brute(sorted(rows)), key=repr)


def test_documents(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert result(df) == sorted(brute(documents), key=repr)


def test_pieces_of_long_texts_have_the_same_anchors(monkeypatch):
    text = made_up(4)
    docs = [(i, t.encode()) for i, t in text]

    def anchors():
        out = []
        for a in suffix_dedup.anchored(docs):
            h = a.tape.hashes(a.at, suffix_dedup.GRAM)
            out += zip(a.doc.tolist(), a.place.tolist(), a.lo.tolist(), a.hi.tolist(), h.tolist())
        return sorted(out)

    whole = anchors()
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    assert anchors() == whole
    # every window belongs to exactly one anchor
    count = {i: max(0, len(t) - suffix_dedup.WINDOW + 1) for i, (_, t) in enumerate(docs)}
    for d, n in count.items():
        starts = np.concatenate([np.arange(lo, hi + 1) for x, _, lo, hi, _ in whole if x == d] or [np.zeros(0)])
        assert sorted(starts.tolist()) == list(range(n))


def test_crowded_grams(monkeypatch):
    """A gram in very many surroundings is compared window by window, with the same result."""
    rows = {k: np.zeros(200, dtype=np.uint64) for k in ("h", "ctx")}
    rows["ctx"] = np.arange(200, dtype=np.uint64)
    rows |= {k: np.zeros(200, dtype=np.uint32) for k in ("left", "right")} | {"key": np.arange(200), "place": np.zeros(200, dtype=np.int64)}
    r, code, go = suffix_dedup._classified(rows, final=False)
    assert (code == suffix_dedup.LEFT | suffix_dedup.RIGHT).all() and go.sum() == 1 and r["wild"][go].all()


def test_hard_rows(spark, hard, nothing):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    known = sorted([r for r in rows if r[0] is not None], key=lambda r: r[0])
    want = brute(known + [r for r in rows if r[0] is None])
    assert sorted((tuple(r)[:3] for r in result(hard)), key=repr) == sorted((w[:3] for w in want), key=repr)
    assert suffix_dedup.remove_repeats(nothing).count() == 0
