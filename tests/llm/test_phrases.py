"""Phrases: the tries against plain look-ups, whole results against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from siteweave.llm import phrases


def plain(docs, least, words, share, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = (text or "").encode().lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text).encode()
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lowered):
            w = [x.decode() for x in re.findall(rb"[^\x20\x09]+", piece)]
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in good.items():
        longer = [b for (g, q), b in good.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(out)


def found(spark, docs, *rule):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(df, *rule).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "d\x01", "e-f", "日本", "Gh", "x"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("words", "shard"), [(3, 300_000), (3, 7), (4, 300_000)])
def test_against_plain_counting(spark, monkeypatch, words, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BLOCK", 400)
    docs = corpus(words + shard, 120)
    rule = (4, words, 50, 25)
    assert found(spark, docs, *rule) == plain(docs, *rule)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tries(depth):
    rng = np.random.default_rng(depth)
    rows = np.unique(np.minimum(rng.zipf(1.3, size=(3000, depth)), 500) * 1_000_003, axis=0)
    trie = phrases.build_trie(rows)
    known = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
    text = rng.choice(np.r_[rows.ravel(), [-1, 17]], 20_000)
    want = [known.get(tuple(text[i : i + depth].tolist()), -1) for i in range(len(text))]
    assert phrases.matches(trie, phrases._symbols(trie, text)).tolist() == want


@pytest.mark.parametrize("words", [3, 4])
def test_text_is_read_as_often_with_many_tries(spark, monkeypatch, words):
    """How often the text is read follows from the length of the phrases, not from the number of candidates."""
    docs, rule, written = corpus(words, 120), (4, words, 50, 25), phrases.written
    monkeypatch.setattr(phrases, "BLOCK", 400)
    tables = {}
    for shard in (300_000, 3):
        monkeypatch.setattr(phrases, "SHARD", shard)
        tables[shard] = []
        monkeypatch.setattr(phrases, "written", lambda df, name, *a, at=tables[shard]: at.append(name) or written(df, name, *a))
        assert found(spark, docs, *rule) == plain(docs, *rule)
    assert tables[300_000] == tables[3]


def test_runs_are_dealt_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 400)
    monkeypatch.setattr(phrases, "RUNS", 50)
    monkeypatch.setattr(phrases, "TOGETHER", 30)
    docs, rule = corpus(11, 120), (4, 4, 50, 25)
    assert found(spark, docs, *rule) == plain(docs, *rule)


@pytest.mark.parametrize("hashes", [None, 1, 3])
def test_shards_count_runs(monkeypatch, hashes):
    """Also when distinct runs share a hash."""
    mixed = phrases._mixed
    if hashes:
        monkeypatch.setattr(phrases, "_mixed", lambda runs: mixed(runs) % np.uint64(hashes))
    rng = np.random.default_rng(5)
    runs, n = rng.integers(0, 30, (4000, 3)).astype("<i4"), rng.integers(1, 5, 4000).astype("<i4")
    want = Counter()
    for r, times in zip(runs.tolist(), n.tolist(), strict=True):
        want[tuple(r)] += times
    distinct, _, times = phrases._alike(runs)
    assert dict(zip(map(tuple, distinct.tolist()), times.tolist(), strict=True)) == Counter(map(tuple, runs.tolist()))
    got = [(tuple(p), a) for rows, total in phrases._count(runs, n, 8, 100) for p, a in zip(rows.tolist(), total.tolist(), strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == {r: a for r, a in want.items() if a >= 8}
    assert not list(phrases._count(runs, n, 10**6, 100))


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 10)
    text = b"aaaa bbbb cccc. dddd eeee ffff, gggg hhhh iiii jjjj kkkk llll mmmm"
    parts = list(phrases._cut(text))
    assert b"".join(parts) == text and len(parts) == 3
    assert list(phrases._cut(b"x " * 50)) == [b"x " * 50]


def test_hard_rows(spark, hard, nothing):
    got = phrases.collocations(hard).collect()
    assert {r.phrase for r in got if r.lang == "en" or r.lang == "und"} == {"word word word"}
    assert phrases.collocations(nothing).count() == 0


def test_blocks_are_sorted_by_number_alone(spark):
    """Ids meet their block by a sort that compares no rows, and a block's codes may stand anywhere among them."""
    rows = [(f"word{i % 7} tab{i % 3} word{i % 5}. more\n" * 30, "en" if i % 2 else "e\tn") for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    blocks = phrases.written(phrases.coded_text(docs), "blocks")
    known = phrases._frequent_words(blocks, 2)[0]
    found = phrases._with_ids(blocks, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[block#\d+L ASC NULLS FIRST\], false", plan)
    word = {r.w1: (r.lang, r.word) for r in known.collect()}
    got = Counter(word[i] for r in found.collect() for i in np.array([*r.ids, -1])[_places(r)] if i >= 0)
    want = Counter((lang, w.encode()) for text, lang in rows for w in text.replace(".", " ").split())
    assert got == {k: n for k, n in want.items() if n >= 2}


def _places(row) -> np.ndarray:
    """The place in ``ids`` of each code of a block, the last one where it has none."""
    place = np.full(row.n_words + 1, len(row.ids))
    place[row.at] = np.arange(len(row.ids))
    return place[np.frombuffer(row.codes, dtype="<i4")]
