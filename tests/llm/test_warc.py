import gzip
import hashlib
import pathlib

import pytest

from loomquery.llm import warc
from loomquery.llm._store import Store


def pages(spark):
    long = "<p>é中😀</p>" * 9000
    same = "a" * 1500
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, "http://a/9", same), (9, "http://a/9", same), (3, "http://b c/\n3", None), (4, None, ""), (5, "u", "short"), (6, "u", "short"), (7, "u7", long), (7, "u7", long), (8, "u8", "x" * 999), (10, "u", "x" * 999), (None, "n", same), (None, None, None), (11, "crlf", "\r\n\r\nWARC/1.1\r\n" * 300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record", "2 AS digest", "3 AS kind").repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        html = html or ""
        same = [p for p, _, h in rows if (h or "") == html and p is not None]
        refers = max(same) if page is not None and len(html.encode()) >= 1000 and page < max(same) else None
        out.append((page, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize(("segment", "chunk"), [(warc.SEGMENT, warc.CHUNK), (700, 64), (200, 7)])
def test_round_trip(spark, segment, chunk):
    df = pages(spark)
    path = Store(spark, "test").path("archives")
    warc.write(df, path, segment=segment, chunk=chunk, records=4)
    got = warc.read(spark, path).collect()
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    assert all(r.digest_ok for r in got)
    assert sorted(bytes(r.payload).decode() for r in got if r.page_id == 7) == [h for p, _, h in rows if p == 7]


def test_archives_are_plain_warc(spark):
    path = Store(spark, "test").path("archives")
    warc.write(pages(spark), path, segment=5000)
    files = [f for f in pathlib.Path(path.removeprefix("file://")).iterdir() if f.name.endswith(".gz")]
    records = [x for f in files for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert {h["warc-type"] for h, _ in records} == {"response", "revisit", "continuation"}
    assert all("warc-segment-origin-id" in h and int(h["warc-segment-number"]) > 1 for h, _ in records if h["warc-type"] == "continuation")


def test_a_lost_segment_fails(spark):
    path = Store(spark, "test").path("archives")
    warc.write(pages(spark), path, segment=5000)
    found = warc.records(spark, path).filter("number IS NULL OR number <> 2")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(found).collect()


def test_other_kinds_are_passed_over(spark):
    path = Store(spark, "test").path("archives")
    warc.write(pages(spark), path, segment=5000)
    before = warc.read(spark, path).count()
    extra = b"".join(warc._record(kind, f"{i:08}-0000-0000-0000-000000000000", b"software: x\r\n", []) for i, kind in enumerate(("warcinfo", "request", "metadata", "resource")))
    (pathlib.Path(path.removeprefix("file://")) / "more.gz").write_bytes(gzip.compress(extra))
    got = warc.read(spark, path)
    assert got.count() == before and {r.record_type for r in got.collect()} == {"response", "revisit"}
    assert warc.records(spark, path).filter("kind = 'warcinfo'").count() == 1


def test_a_record_of_many_segments(spark):
    path = Store(spark, "test").path("archives")
    payload = "é中 " * 200_000
    warc.write(spark.createDataFrame([(1, "u", payload)], "page_id long, url string, html string"), path, segment=1000)
    row = warc.read(spark, path).first()
    assert bytes(row.payload).decode() == payload and row.digest_ok


def test_empty_table(spark):
    path = Store(spark, "test").path("archives")
    warc.write(pages(spark).limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_chunked_framing():
    payload = "héllo wörld 中文".encode() * 50
    for size in (1, 3, 10, 10_000):
        assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")
