import base64
import gzip
import hashlib

import pytest

from siteweave.llm import warc
from siteweave.plans.stages import fresh_path


def expected(rows):
    """Plain rule over (page_id, html) rows."""
    last = {}
    for i, html in rows:
        last[html or ""] = max((x for x in (last.get(html or ""), i) if x is not None), default=None)
    out = []
    for i, html in rows:
        body = (html or "").encode()
        to = last[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, *(("response", None) if to is None or to == i else ("revisit", to)), body))
    return sorted(out, key=repr)


PAGES = [(1, "<p>ä</p>"), (2, "<p>ä</p>"), (3, None), (4, ""), (5, "x\r\n\r\nWARC/1.1\r\n\r\n"), (9, "z" * 70_000), (None, "<p>ä</p>"), (9, "z" * 70_000), (None, "lone")]


def round_trip(spark, pages, **options):
    path = fresh_path(spark, "test-warc")
    warc.write_warc(pages, path, **options)
    return path, warc.read_warc(spark, path)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, f"http://a/{i}\n", h, "t", 0) for i, h in PAGES], "page_id long, url string, html string, refers_to string, member int")
    path, got = round_trip(spark, df, segment_bytes=10_000)
    want = [w if w[3] == "response" else (*w[:5], b"") for w in expected(PAGES)]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    # any gzip reader reads the files, and every record is a member of its own
    plain = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect() if r.content)
    assert plain.count(b"WARC-Type: response") == 6 and plain.count(b"WARC-Type: continuation") == 12


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(i, None, h) for i, h in PAGES], "page_id long, url string, html string")
    _, got = round_trip(spark, df, min_bytes=9)
    assert {r.payload_bytes for r in got.collect() if r.record_type == "revisit"} == {9, 70_000} - {70_000}


def test_empty_table(spark):
    _, got = round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0


def test_damage_is_found():
    good = b"".join(warc.members(1, "u", b"hello", None)) + b"".join(warc.members(2, "u", b"again", 1))
    assert [(r["id"], r["type"], r["length"]) for r in warc.records(memoryview(good))] == [("<urn:page:1>", "response", 5), ("<urn:page:2>", "revisit", 5)]
    with pytest.raises(EOFError):
        list(warc.records(memoryview(good[:-10])))
    wrong = gzip.compress(gzip.decompress(b"".join(warc.members(1, "u", b"hello", None))).replace(b"hello", b"hullo"))
    with pytest.raises(warc.DigestError):
        list(warc.records(memoryview(wrong)))
    short = gzip.compress(gzip.decompress(b"".join(warc.members(1, "u", b"hello", None))).replace(b"\r\n\r\nhello\r\n\r\n", b"\r\n\r\nhel"))
    with pytest.raises(ValueError):
        list(warc.records(memoryview(short)))
