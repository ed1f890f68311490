"""WARC archives: writing records in segments, and reassembling them.

Archives are plain WARC files (gzip as a whole), written and read by Spark's
own sources, so any store that Spark reaches can hold them. A payload travels
in an HTTP response with chunked transfer framing; a block larger than a
segment continues in records that name their origin and their number. The
reader groups continuation records by origin identifier, orders them by
segment number, verifies the total length and decodes the chunks. Records of
one segment never meet a shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm._store import arrow_map

#: Bytes of a block in one record, bytes of a chunk, records in one archive, and the least payload that is stored once.
SEGMENT, CHUNK, RECORDS, REVISIT = 32 << 10, 8 << 10, 4096, 1000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)")


def boundary(raw: bytes, at: int) -> int:
    """The last position up to at that splits no UTF-8 sequence."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    out, at = [], 0
    while at < len(payload):
        end = boundary(payload, at + size)
        end = end if end > at else min(len(payload), at + size)
        out.append(b"%x\r\n%b\r\n" % (min(end, len(payload)) - at, payload[at:end]))
        at = min(end, len(payload))
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload within chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        at += size + 2


def _record(kind: str, record: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record}>"), ("WARC-Date", _DATE), *more, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_segments(row: dict, segment: int, chunk: int) -> list[bytes]:
    """The records, one or more, that hold a row of write()."""
    record, payload = row["record"], row["payload"]
    more = [("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    if row["page"] is not None:
        more.append(("X-Page-Id", str(row["page"])))
    if row["url"] is not None:
        more.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    kind = ("Content-Type", "application/http;msgtype=response")
    if payload is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["size"]
        return [_record("revisit", record, http, [*more, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(row["refers"])), kind])]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record("response", record, block, [*more, kind])]
    parts, at = [], 0
    while at < len(block):
        end = min(boundary(block, at + segment) if at + segment < len(block) else len(block), len(block))
        parts.append(block[at:end])
        at = end
    out = [_record("response", record, parts[0], [*more, ("WARC-Segment-Number", "1"), kind])]
    for k, part in enumerate(parts[1:], 2):
        own = hashlib.md5(f"{record}/{k}".encode()).hexdigest()
        end = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(_record("continuation", f"{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}", part, [("WARC-Segment-Origin-ID", f"<urn:uuid:{record}>"), ("WARC-Segment-Number", str(k)), *end]))
    return out


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT) -> DataFrame:
    """What each record will hold: of equal payloads of least bytes or more, the row with the largest id holds it, the others refer to that.

    A null payload is empty. Rows that repeat the largest id all hold the
    payload; rows with a null id never are referred to, and refer to nothing.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    copies = rows.filter((F.col("size") >= least) & F.col("page").isNotNull()).groupBy("digest", "size").agg(F.max("page").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(copies, ["digest", "size"], "left")
    rows = rows.withColumn("refers", F.when(F.col("page") < F.col("holder"), F.col("holder")))
    uid = F.md5(F.concat_ws("/", F.coalesce(F.col("page").cast("string"), F.lit("-")), F.coalesce("url", F.lit("")), "digest"))
    uid = F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return rows.select("page", "url", uid.alias("record"), "digest", "size", "refers", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, records: int = RECORDS, **columns) -> None:
    """Write a record per row of pages to archives in a new folder."""

    def build(batch: pa.RecordBatch):
        out: list[bytes] = []
        held = 0
        for row in batch.to_pylist():
            row["payload"] = None if row["payload"] is None else row["payload"].encode()
            out += record_segments(row, segment, chunk)
            held += len(out[-1])
            if held > 8 << 20:
                yield _values(out)
                out, held = [], 0
        if out:
            yield _values(out)

    def _values(out):
        # the text writer ends each value by a line feed, which is the record's last byte
        return pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], ["value"])

    lines = arrow_map(plan(pages, **columns), build, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(raw: bytes):
    """(headers, block) of each record of an archive. Header names are in lower case."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] in (b"\r\n",):
            at += 2
            continue
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head["content-length"])
        yield head, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_FIELDS = "record string, kind string, origin string, number int, total long, page long, url string, digest string, refers long, block binary"
_OUT = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, continuation records included."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")

    def split(batch: pa.RecordBatch):
        for value in batch.column(0):
            rows = []
            for head, block in parse(gzip.decompress(value.as_buffer())):
                number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                rows.append({"record": head["warc-record-id"].strip("<>"), "kind": head["warc-type"], "origin": head.get("warc-segment-origin-id", "").strip("<>") or None, "number": number("warc-segment-number"), "total": number("warc-segment-total-length"), "page": number("x-page-id"), "url": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers": number("x-refers-to-page-id"), "block": block})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("record", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.int64()), ("block", pa.binary())])
    return arrow_map(files, split, _FIELDS)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole blocks: segments grouped by origin, ordered by number, their length verified.

    Records that repeat, id and all, are joined once and returned as often as
    their first segment occurs. A record whose segments don't add up to
    numbers 1 to n or to the total length fails the job: an archive with a
    lost segment can't be given back whole. Without records it is empty.
    """
    whole = found.filter("number IS NULL").select("kind", "page", "url", "digest", "refers", "block")
    first = F.col("number") == 1
    parts = found.filter("number IS NOT NULL").groupBy(F.coalesce("origin", "record").alias("id"), "number").agg(
        F.first("block").alias("block"), F.max("total").alias("total"), F.count("*").alias("copies"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("kind", "page", "url", "digest", "refers")],
    )
    joined = parts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(first, F.col("copies"))).alias("copies"), *[F.max(F.when(first, F.col(c))).alias(c) for c in ("kind", "page", "url", "digest", "refers")],
    )

    def join(batch: pa.RecordBatch):
        out = []
        for r in batch.to_pylist():
            block = b"".join(p["block"] or b"" for p in r["parts"])
            if [p["number"] for p in r["parts"]] != list(range(1, len(r["parts"]) + 1)) or len(block) != r["total"]:
                raise ValueError(f"segments are missing: {r['id']}")
            out += [{"kind": r["kind"], "page": r["page"], "url": r["url"], "digest": r["digest"], "refers": r["refers"], "block": block}] * r["copies"]
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("kind", pa.string()), ("page", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.int64()), ("block", pa.binary())])
    return whole.unionByName(arrow_map(joined, join, "kind string, page long, url string, digest string, refers long, block binary"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit in the archives: the page, its payload (null for a revisit), length, digest, type and the page it refers to.

    Lengths and digests of responses are taken from the decoded payload, and
    digest_ok says whether the digest is the one in the header. Records of
    other kinds (warcinfo, request, metadata, …) are passed over; archives
    without records give an empty result.
    """

    def decode(batch: pa.RecordBatch):
        out = []
        for r in batch.to_pylist():
            head, _, body = r["block"].partition(b"\r\n\r\n")
            if r["kind"] == "revisit":
                out.append((r["page"], r["url"], None, int(_LENGTH.search(head)[1]), r["digest"], "revisit", r["refers"], True))
                continue
            payload = unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
            digest = hashlib.sha1(payload).hexdigest()
            out.append((r["page"], r["url"], payload, len(payload), digest, "response", None, r["digest"] in (None, digest)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return arrow_map(reassemble(records(spark, path)).filter("kind IN ('response', 'revisit')"), decode, _OUT)
