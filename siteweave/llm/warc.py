"""WARC archives: written with one gzip member per record, read sequentially.

Archives are written and read by Spark's own file sources, so they work in any store and with any
number of retries. The text sink ends each row with a byte of our choice, and the last byte of a
gzip member is zero as long as the record is shorter than 16 MiB (it is the top byte of the size).
So each row holds a member without its last byte and the sink adds it. Longer payloads are
continued in further records, as the standard's segmentation describes, which also bounds what a
reader holds.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# Payload bytes per record; a record must stay below 16 MiB.
SEGMENT_BYTES = 8 << 20
READ_BYTES = 1 << 16
_ID = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"


class DigestError(ValueError):
    """A payload that is not the one its record names."""


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    record = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def members(page_id, url: str | None, payload: bytes, refers_to, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Gzip members of one page: a response in one or more segments, or a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    uri = "".join(c for c in url or "" if c > " ")
    named = [
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest_text(hashlib.sha1(payload).digest())),
    ]
    record_id = ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>")
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        link = [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", profile)]
        yield _member([("WARC-Type", "revisit"), record_id, *named, *link, kind], http)
        return
    cuts = list(range(0, max(1, len(payload)), segment))
    for number, at in enumerate(cuts, 1):
        block = payload[at : at + segment]
        if number == 1:
            more = [("WARC-Segment-Number", "1")] if len(cuts) > 1 else []
            yield _member([("WARC-Type", "response"), record_id, *named, *more, kind], http + block)
        else:
            origin = ("WARC-Segment-Origin-ID", record_id[1])
            own = ("WARC-Record-ID", f"{record_id[1][:-1]}/{number}>")
            last = [("WARC-Segment-Total-Length", str(len(http) + len(payload)))] if at == cuts[-1] else []
            yield _member([("WARC-Type", "continuation"), own, *named, origin, ("WARC-Segment-Number", str(number)), *last], block)


class _Stream:
    """Bytes of one gzip member, decompressed a little at a time."""

    def __init__(self, data: memoryview):
        self.data, self.at = data, 0

    def member(self) -> bool:
        """Start the next member; false at the end of the file."""
        if self.at >= len(self.data):
            return False
        self.z, self.plain = zlib.decompressobj(31), bytearray()
        return True

    def more(self) -> bool:
        if self.z.eof:
            return False
        if self.z.unconsumed_tail:
            self.plain += self.z.decompress(self.z.unconsumed_tail, READ_BYTES)
        elif self.at >= len(self.data):
            raise EOFError("archive ends inside a record")
        else:
            piece = self.data[self.at : self.at + READ_BYTES]
            self.at += len(piece)
            self.plain += self.z.decompress(piece, READ_BYTES)
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def head(self) -> dict[str, str]:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("record without end of headers")
        lines = bytes(self.plain[:end]).decode().split("\r\n")
        del self.plain[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}

    def block(self, length: int) -> Iterator[bytes]:
        """Exactly ``length`` bytes, then the record's end."""
        while length:
            while not self.plain:
                if not self.more():
                    raise ValueError("record shorter than its Content-Length")
            piece = bytes(self.plain[:length])
            del self.plain[: len(piece)]
            length -= len(piece)
            yield piece
        while self.more():
            pass
        if self.plain != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")


def records(data: memoryview) -> Iterator[dict]:
    """Responses and revisits of one archive, continuations joined; verifies digests on the way."""
    stream, entry = _Stream(data), None

    def closed(x: dict) -> dict:
        if x["type"] == "response" and (digest_text(x["sha1"].digest()) != x["digest"] or x["bytes"] != x["length"]):
            raise DigestError(f"payload of {x['id']} does not match its record")
        return x

    while stream.member():
        head = stream.head()
        parts = stream.block(int(head["content-length"]))
        kind = head["warc-type"]
        if kind != "continuation":
            if entry:
                yield closed(entry)
                entry = None
            if kind not in ("response", "revisit"):
                for _ in parts:
                    pass
                continue
            http, rest = b"", b""
            for piece in parts:
                http += piece
                if (end := http.find(b"\r\n\r\n")) >= 0:
                    http, rest = http[:end], http[end + 4 :]
                    break
            fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
            entry = {
                "id": head["warc-record-id"], "type": kind, "uri": head.get("warc-target-uri", ""), "payload": [rest],
                "digest": head["warc-payload-digest"].removeprefix("sha1:"), "refers_to": head.get("warc-refers-to"),
                "length": int(fields[b"content-length"]), "sha1": hashlib.sha1(rest), "bytes": len(rest),
            }
        elif entry is None or head["warc-segment-origin-id"] != entry["id"]:
            raise ValueError("continuation without its first record")
        for piece in parts:
            entry["sha1"].update(piece)
            entry["bytes"] += len(piece)
            entry["payload"].append(piece)
    if entry:
        yield closed(entry)


def decide(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: null for responses, else the largest id with an equal payload.

    Payloads under ``min_bytes`` bytes are all responses. The table of first copies has one row
    per payload and is combined before its shuffle; a payload with very many copies is split by the
    adaptive skew join.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    digest = F.when(F.length(payload) >= min_bytes, F.sha1(payload))
    marked = pages.withColumn("__sw_digest", digest)
    last = marked.where("__sw_digest is not null").groupBy("__sw_digest").agg(F.max(id_column).alias("__sw_last"))
    target = F.when(~F.coalesce(F.col(id_column) == F.col("__sw_last"), F.col("__sw_last").isNull()), F.col("__sw_last"))
    return marked.join(last, "__sw_digest", "left").withColumn("refers_to", target).drop("__sw_digest", "__sw_last")


def write_warc(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """One record per row. Null payloads are empty, null urls have an empty target.

    Of rows with equal payloads the one with the largest id is a response, the others are revisits
    of it; rows that share that id are all responses, and so are payloads whose ids are all null.
    Empty tables give archives without records; other columns are ignored.
    """
    if segment_bytes > (15 << 20):
        raise ValueError("a record must stay below 16 MiB")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, urls, payloads, refs = (batch.column(i) for i in range(4))
            out, size = [], 0
            for row in range(batch.num_rows):
                body = payloads[row].as_py() or ""
                made = b"".join(m for m in members(ids[row].as_py(), urls[row].as_py(), body.encode(), refs[row].as_py(), segment_bytes))
                if made[-1]:
                    raise AssertionError("a member whose last byte is not zero")
                out.append(made[:-1])
                size += len(made)
                if size > (16 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    narrow = pages.select(id_column, url_column, payload_column)
    rows = decide(narrow, id_column, payload_column, min_bytes).select(id_column, url_column, payload_column, "refers_to")
    made = rows.mapInArrow(run, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) per record.

    Files are read one after the other in a task, each from front to back. A digest or a length
    that does not fit its record is an error, and so is a file that ends inside a record.
    """

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

        def number(uri):
            return int(text) if uri and (text := uri.strip("<>").removeprefix(_ID)) else None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file in batch.column(0):
                rows, held = [], 0
                for r in records(memoryview(file.as_buffer())) if file.as_buffer() else ():
                    rows.append((number(r["id"]), r["uri"], r["length"], r["digest"], r["type"], number(r["refers_to"])) + ((b"".join(r["payload"]),) if payloads else ()))
                    held += r["bytes"] if payloads else 200
                    if held > (16 << 20):
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(run, kinds + (", payload binary" if payloads else ""))
