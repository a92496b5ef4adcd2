import base64
import gzip
import hashlib
import os
from collections import Counter

import pytest
from pyarrow import fs

from matchlane.llm import queries, warc

SCHEMA = "page_id long, url string, html string, key string, copy int, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "f") for r in rows], SCHEMA)


def expected(rows, least=0):
    first, result = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page_id, _, html in order:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        known = body in first and len(body) >= least
        first.setdefault(body, page_id)
        result.append((page_id, len(body), digest, "revisit" if known else "response", first[body] if known else None))
    return Counter(result)


def round_trip(found, tmp_path, **how):
    manifest = warc.write_archives(found, str(tmp_path / "archives"), **how)
    return manifest, warc.resolved(warc.read_archives(manifest))


ROWS = [
    (3, "http://a/1", "same"),
    (1, "http://a/2", "same"),
    (2, "http://a/\r\nX: y ü", "ünïcode\r\n\r\nWARC/1.1\r\n\r\n"),
    (4, None, None),
    (5, "http://b", ""),
    (6, "http://b", "sam"),
    (None, "http://c", "same"),
    (None, "http://d", "alone"),
    (8, "http://e", "twice"),
    (8, "http://e", "twice"),
    (8, "http://e", "twice"),
    (9, "http://e", "twice"),
    (10, "http://f", "x" * 3_000_000),
]


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, tmp_path, least):
    manifest, got = round_trip(warc.records(pages(spark, ROWS), least), tmp_path)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == expected(ROWS, least)
    assert sum(r.records for r in manifest.collect()) == len(ROWS)


def test_archives_are_plain_records(spark, tmp_path):
    manifest, got = round_trip(warc.records(pages(spark, ROWS).coalesce(1)), tmp_path, archive_bytes=1000)
    files = [r.archive for r in manifest.collect()]
    assert len(files) > 1 and all(os.path.getsize(r.archive) == r.bytes for r in manifest.collect())
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC-Type: response\r\n") == 7 and text.count(b"WARC-Type: revisit\r\n") == 6
    assert b"WARC-Target-URI: http://a/%0D%0AX:%20y%20%C3%BC\r\n" in text
    assert Counter(map(tuple, got.collect())) == expected(ROWS)


def test_payloads_come_in_chunks_with_running_digests(spark, tmp_path):
    body = "".join(f"<p>{i} é</p>" for i in range(60_000))
    manifest, _ = round_trip(warc.records(pages(spark, [(1, "u", body), (2, "u", "small")])), tmp_path)
    chunks = warc.read_archives(manifest, chunk_bytes=100_000).orderBy("page_id", "chunk").collect()
    big = [r for r in chunks if r.page_id == 1]
    data = body.encode()
    assert [r.chunk for r in big] == list(range(-(-len(data) // 100_000))) and max(len(r.body) for r in big) == 100_000
    assert b"".join(r.body for r in big) == data
    for r in big:
        prefix = data[: r.payload_bytes]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(prefix).digest()).decode()
    assert [r.last for r in big] == [False] * (len(big) - 1) + [True] and big[-1].header_digest == big[-1].payload_digest


def test_damage_is_refused(tmp_path):
    path = str(tmp_path / "a.warc.gz")
    writer = warc.ArchiveWriter(path)
    writer.record("response", "urn:uuid:1", 1, "http://x", None, memoryview(b"abcdef"))
    writer.close()
    whole = gzip.open(path).read()
    for broken, message in ((gzip.compress(whole.replace(b"abcdef", b"abcdeg")), "damaged"), (open(path, "rb").read()[:-30], "inside a record")):
        (tmp_path / "b.warc.gz").write_bytes(broken)
        stream = fs.LocalFileSystem().open_input_stream(str(tmp_path / "b.warc.gz"), compression=None)
        with pytest.raises(ValueError, match=message):
            list(warc.read_chunks(stream))


def test_no_pages(spark, tmp_path):
    manifest, got = round_trip(warc.records(pages(spark, [])), tmp_path)
    assert manifest.count() == 0 and got.count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert Counter(map(tuple, queries.op13_chunked_records(spark, sf).collect())) == expected(rows)
