from hypothesis import given, settings, strategies as st

from siteweave.llm import simhash
from siteweave.llm.common import ASCII_LOWER


def components(fps: dict, max_bits: int) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def plain_fingerprint(text: str) -> int:
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(ASCII_LOWER))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé \n\t\x0b.ß", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode().translate(ASCII_LOWER).split(), 4) == plain_fingerprint(text)


def test_query_against_all_pairs(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in documents}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == components(fps, 4)


def test_close_fingerprints_in_crowded_buckets(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "BLOCK", 16)
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(3)]
    fps = set(base)
    while len(fps) < 300:
        b = random.choice(base)
        for bit in random.sample(range(64), random.randint(0, 6)):
            b ^= 1 << bit
        fps.add(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()
    assert len(pairs) < 3 * len(fps) * 8  # forests, not all pairs
    from siteweave.llm.components import components as linked

    edges = spark.createDataFrame([(r.a, r.b) for r in pairs], "a long, b long")
    got = {r.node: r.component for r in linked(edges, "a", "b").collect()}
    want = components({f: f % (1 << 64) for f in signed}, 4)
    assert {f: got.get(f, f) for f in signed} == want


def test_hard_rows(hard, nothing):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[5] == by_id[7] == 5 and by_id[8] == by_id[9] == by_id[10] == 8
    assert {r.component_id for r in rows if r.doc_id is None} == {5, 8}
    assert simhash.near_duplicates(nothing).count() == 0
