import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteweave.llm import packing, token_output, tokens
from siteweave.plans import stages
from siteweave.plans.stages import fresh_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["x\ny", "\r", ".\n", " ", "  ", "\n", "\t", "a", "B", "é", "É", "1", "23", ".", ",", "'s", "'", "don't", "́", "🙂", "_", "日本", "²", "\x1c", " \n", "<|endoftext|>", "ſ", "İ", "ΑΣ", "Σ", " "]


@pytest.fixture(scope="module")
def library():
    out = {}
    for f in FILES:
        out[f] = Tokenizer.from_file(tokens.public_path(f))
        out[f].encode_special_tokens = True
    return out


@pytest.mark.parametrize("file", FILES)
def test_words_give_the_ids_of_the_whole_text(library, file):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(ODD), max_size=30).map("".join))
    def same(text):
        want = library[file].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encoder(tokens.public_path(file)).encode(text), "<u4").tolist() == want

    same()


@pytest.mark.parametrize("file", FILES)
def test_words_joined_by_a_line_end_are_not_remembered(library, file):
    """Only their parts are, so that pairs of words do not drive words out of the memory."""
    encoder = tokens.Encoder(tokens.public_path(file))
    text = "One two.\nThree fourth\nfifth, sixth!\nSeventh é.\nÉté"
    want = library[file].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == want
    known = {*encoder.rest, *encoder.first}
    assert "two." in known and not any("\n" in word for word in known)


def test_forgetting_words_changes_nothing(library, documents, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encode = tokens.Encoder(tokens.public_path(FILES[0])).encode
    for _, text in documents[:20]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library[FILES[0]].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_columns_give_the_ids_of_the_whole_texts(library, file, monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER_BYTES", 40)
    encoders = [tokens.Encoder(tokens.public_path(file), r) for r in (3, tokens.REMEMBERED)]
    words = [*ODD, "J", "h", "\u030c", "\u0331", "One", "ONE!", "one.##", "École,", "ÉCOLE", "שׁ", "ẞ.", "\0.", "it's", "x\ny.\n\nZ"]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.none() | st.lists(st.sampled_from(words), max_size=12).map("".join), max_size=8))
    def same(texts):
        want = [library[file].encode(t or "", add_special_tokens=False).ids for t in texts]
        for encoder in encoders:
            for column in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
                assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_column(column)] == want

    same()


def test_packing_remembers_words_without_case_and_marks():
    """In arrays of few bytes a word; the Python objects of the words and their ids took most of a worker's memory."""
    encoder = tokens.Encoder(tokens.public_path(FILES[1]), 500)
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=4)]
    for i in range(0, len(words), 100):
        assert len([*encoder.encode_column(pa.array([f"{w} {w.title()}, {w.upper()}!!" for w in words[i : i + 100]]))]) == 100
        assert len(encoder.column.known) == len(encoder.column.ids) <= 1000
        assert encoder.column.known.nbytes + encoder.column.ids.nbytes < 1000 * 40
        assert not any(w.strip("!,") != w or w != w.lower() for w in encoder.column.known.to_pylist())
    assert len(encoder.rest) + len(encoder.rest.old) < 10


def ids_of(library, file, text, end):
    return np.array(library[file].encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_token_files(spark, library, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(7)
    path = fresh_path(spark, "test-tokens")
    token_output.write_tokens(df, path, tokens.public_path(FILES[0]), 2)
    got = {r.doc_id: r for r in token_output.checksums(token_output.read_tokens(spark, path)).collect()}
    start = 0
    for i, text in documents:
        ids = ids_of(library, FILES[0], text, 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq
    from pathlib import Path

    chunk = next(pq.ParquetFile(p).metadata.row_group(0) for p in Path(path.removeprefix("file:")).glob("*.parquet"))
    ids_column = next(chunk.column(i) for i in range(chunk.num_columns) if chunk.column(i).path_in_schema.startswith("ids"))
    assert ids_column.has_dictionary_page and ids_column.has_offset_index


def test_token_files_of_hard_rows(spark, hard, nothing):
    path = fresh_path(spark, "test-tokens")
    token_output.write_tokens(hard, path, tokens.public_path(FILES[0]), 2)
    rows = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == hard.count() and [r.doc_id for r in rows][:2] == [None, None]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2
        at += r.n_tokens
    token_output.write_tokens(nothing, path, tokens.public_path(FILES[0]), 2)
    assert token_output.checksums(token_output.read_tokens(spark, path)).count() == 0


def whole(rows, library, texts):
    """Every id in exactly one piece, sequences gapless; returns padding to full windows."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts:
        ids, at = ids_of(library, FILES[1], text, 1), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 2048 - at
    return padding


def test_packing(spark, library, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    rows = packing.pack(df, tokens.public_path(FILES[1]), 1, shard_bytes=200_000).collect()
    shards = {r.sequence_id >> 32 for r in rows}
    assert len(shards) > 1
    assert whole(rows, library, documents) < 2048 * len(shards)
    again = packing.pack(df.repartition(3), tokens.public_path(FILES[1]), 1, shard_bytes=200_000)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint32) for _ in range(60)]
    index, unused = packing.Index(docs), rng.random(60) < 0.7
    mean = np.mean([len(d) for d in docs])

    def score(query, d):
        s = 0.0
        for t in set(query.tolist()):
            tf, df = (docs[d] == t).sum(), sum(t in x for x in docs)
            s += np.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))
        return s

    for seed in range(20):
        found = index.neighbours(seed, unused)
        want = {d: score(docs[seed], d) for d in range(60) if unused[d]}
        assert set(found.tolist()) == {d for d, s in want.items() if s > 0}
        assert np.allclose([want[d] for d in found], sorted((s for s in want.values() if s > 0), reverse=True))


def test_packing_of_hard_rows(hard, nothing, library):
    rows = packing.pack(hard, tokens.public_path(FILES[1]), 1).collect()
    single = [(r.doc_id, r.text) for r in hard.collect() if r.doc_id not in (None, 7)]
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    for i, text in single:
        assert got[i] == len(ids_of(library, FILES[1], text, 1))
    assert got[7] == 2 * len(ids_of(library, FILES[1], hard.where("doc_id = 7").first().text, 1))
    assert packing.pack(nothing, tokens.public_path(FILES[1]), 1).count() == 0


def test_packing_finds_neighbours_in_the_whole_corpus(spark):
    """Copies with ids of their own meet, wherever the ids would have been dealt to."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 7)) for _ in range(4000)]
    topics = [" ".join(rng.choice(rng.choice(words, 60), 250)) for _ in range(60)]
    rows = [(100 * c + i, t) for c in range(2) for i, t in enumerate(topics)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, tokens.public_path(FILES[1]), 1, shard_bytes=40_000).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id].add(r.sequence_id >> 32)
    assert len(set().union(*shards.values())) > 3
    assert sum(shards[i] == shards[100 + i] for i in range(60)) >= 54


def test_packing_stores_two_bytes_an_id_and_sends_few_rows_at_a_time(spark, library, documents, monkeypatch):
    """Larger batches, which are held several times over, took an executor above its memory."""
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)

    def written(df, name):
        seen.append((spark.conf.get(setting), stages.written(df, name)))
        return seen[-1][1]

    monkeypatch.setattr(packing, "written", written)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    rows = packing.pack(df, tokens.public_path(FILES[1]), 1, batch_rows=7).collect()
    assert whole(rows, library, documents) < 2048
    [(most, encoded)] = seen
    assert most == "7" and spark.conf.get(setting) == before
    assert encoded.agg(F.sum(F.octet_length("tokens"))).first()[0] == 2 * sum(r.length for r in rows)


def test_packing_of_ids_above_two_bytes(spark, library):
    texts = [(1, "one two three"), (2, None), (3, "four " * 3000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokens.public_path(FILES[1]), 70_000).collect()
    for i, text in texts:
        want = ids_of(library, FILES[1], text, 70_000)
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum((r.ids for r in pieces), []) == want.tolist()
        assert {r.doc_tokens for r in pieces} == {len(want)}
