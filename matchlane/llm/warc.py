"""WARC archives written from pages and read back as a chunked record table.

Writing: payload digests are worked out in one pass; payloads that several pages share are listed with
their smallest page_id, whose record is the ``response``; the others become ``revisit`` records that
refer to it and hold no payload. Each task then writes its pages straight into gzip archives (a member
per record, a new archive after about ``ARCHIVE_BYTES``) in the shared folder, a chunk at a time. An
archive's name is new in every attempt, and only the archives of finished tasks are in the manifest,
a written table, so a lost executor leaves at most a file that nobody reads.

Reading: a task opens its archives as streams and yields one row per record and chunk of at most
``CHUNK_BYTES`` payload bytes: record identifier, chunk number, bytes and digest of the payload so far.
SHA-1 is carried from chunk to chunk, the last chunk has the whole digest, and a payload that differs
from its header's digest is refused. No record is ever held whole.

A page whose own payload has fewer than ``least`` bytes is always a response. Nulls: a null html is an
empty payload; a null page_id comes last and is left out of the header; a null url is left out.
Repeated rows (same page_id and payload) are one response and revisits of it. Characters below 33 and
above 126 of urls are percent-encoded. No pages give no archives. Other columns are not read.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.operators.joins import join_lookup
from matchlane.session import materialise, work_path

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "archive string, records long, bytes long"
CHUNKS = (
    "archive string, record_id string, chunk int, record_type string, page_id long, refers_to_record string, "
    "header_digest string, payload_bytes long, payload_digest string, last boolean"
)


def digest_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_key(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256)


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, key, copy, first, shared: pages with the smallest page_id of their payload.

    ``copy`` counts the repetitions of a row; payloads of one page alone are not ``shared``.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("key", payload_key(F.col("html")))
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= least
    facts = materialise(read.where(long_enough).groupBy("key", "page_id").agg(F.count("*").alias("n")), "warc-payloads")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    shared = facts.groupBy("key").agg(F.sum("n").alias("total"), F.min_by("page_id", order).alias("first"), F.min_by("n", order).alias("n"))
    shared = materialise(shared.where("total > 1"), "warc-shared")
    joined = join_lookup(read, shared.withColumn("shared", F.lit(True)), ["key"], F.struct("page_id", "url"), "left")
    joined = joined.withColumn("shared", F.coalesce("shared", F.lit(False)) & long_enough)
    columns = ["page_id", "url", "html", "key", "copy", "first", "shared"]
    if shared.where("n > 1").isEmpty():
        return joined.withColumn("copy", F.lit(1).cast("long")).select(*columns)
    # The row that becomes the response is itself repeated: one of its rows stays, the rest are copies.
    repeated = F.col("shared") & (F.col("n") > 1) & F.col("page_id").eqNullSafe(F.col("first"))
    single = joined.where(~repeated).withColumn("copy", F.lit(1).cast("long"))
    grouped = joined.where(repeated).groupBy("key", "page_id").agg(
        F.min("url").alias("url"), F.first("html").alias("html"), F.first("first").alias("first"), F.count("*").alias("n")
    )
    copies = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("shared", F.lit(True))
    return single.select(*columns).unionByName(copies.select(*columns))


def record_name(page_id: Column, key: Column, copy: Column) -> Column:
    """A uuid made from what identifies a record, equal in every attempt."""
    text = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), key, copy.cast("string")))
    cut = [F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """record_id, record_type, page_id, url, refers_to_record, html: what is written."""
    roles = with_roles(pages, least)
    first = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    revisit = F.col("shared") & ~first
    return roles.select(
        record_name(F.col("page_id"), F.col("key"), F.col("copy")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "url",
        F.when(revisit, record_name(F.col("first"), F.col("key"), F.lit(1))).alias("refers_to_record"),
        F.coalesce("html", F.lit("")).alias("html"),
    )


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, root


def _url(text: str) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


class ArchiveWriter:
    """One gzip archive, a member for each record; payloads go through in chunks."""

    def __init__(self, path: str):
        self.path, self.records, self.bytes = path, 0, 0
        system, target = _folder(path)
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(target, compression=None)  # packed here, by record

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def record(self, kind: str, name: str, page_id: int | None, url: str | None, refers_to: str | None, payload: memoryview) -> None:
        digest = hashlib.sha1(payload)
        body = memoryview(b"") if kind == "revisit" else payload
        head = HTTP_HEAD % len(payload)
        fields = {
            "WARC-Type": kind,
            "WARC-Record-ID": f"<{name}>",
            "WARC-Date": DATE,
            "WARC-Target-URI": url and _url(url),
            "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": f"sha1:{digest_text(digest.digest())}",
            "WARC-Refers-To": refers_to and f"<{refers_to}>",
            "WARC-Profile": IDENTICAL if kind == "revisit" else None,
            "Page-ID": page_id,
            "Content-Length": len(head) + len(body),
        }
        lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + head))
        for at in range(0, len(body), CHUNK_BYTES):
            self._put(packer.compress(body[at : at + CHUNK_BYTES]))
        self._put(packer.compress(b"\r\n\r\n") + packer.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def _cells(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each string, without a copy."""
    column = column.cast(pa.large_string())
    offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1]
    body = memoryview(column.buffers()[2] or b"")
    for start, end in zip(offsets, offsets[1:], strict=False):
        yield body[start:end]


def write_archives(found: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records`` and returns the manifest: archive, records, bytes."""
    root = folder or work_path(found.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("record_type", "record_id", "page_id", "url", "refers_to_record")]
            for row in zip(*columns, _cells(batch["html"]), strict=True):
                writer = writer or ArchiveWriter(f"{root}/{uuid.uuid4().hex}.warc.gz")
                writer.record(*row)
                if writer.bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        done += [writer.close()] if writer else []
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_pydict(
            {"archive": pa.array(names, pa.string()), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())}
        )

    return materialise(found.mapInArrow(write, MANIFEST), "warc-manifest")


class _Member:
    """The unpacked bytes of one gzip member after another, read through a small buffer."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.packed, self.unpacker, self.held = stream, b"", None, b""

    def open(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        while self.unpacker and not self.unpacker.eof:  # what is left of the last one
            self._more()
        self.packed = (self.unpacker.unused_data if self.unpacker else b"") or self.stream.read(1 << 16)
        self.unpacker, self.held = (zlib.decompressobj(31), b"") if self.packed else (None, b"")
        return bool(self.packed)

    def _more(self) -> bytes:
        packed = self.packed or self.unpacker.unconsumed_tail or self.stream.read(1 << 16)
        if not packed or self.unpacker.eof:
            raise ValueError("an archive ends inside a record")
        self.packed = b""
        return self.unpacker.decompress(packed, CHUNK_BYTES)

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is passed over."""
        while (at := self.held.find(mark)) < 0:
            self.held += self._more()
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def upto(self, n: int) -> bytes:
        """At least one and at most ``n`` of the next bytes."""
        while not self.held:
            self.held = self._more()
        found, self.held = self.held[:n], self.held[n:]
        return found


def read_chunks(stream: pa.NativeFile, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[dict, int, bytes, str, int, bool]]:
    """(header, chunk number, chunk, digest so far, payload bytes so far, whether it is the last) of every record."""
    member = _Member(stream)
    while member.open():
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]}")
        header = dict(line.split(": ", 1) for line in lines[1:])
        left = int(header["Content-Length"])
        left -= len(member.until(b"\r\n\r\n")) + 4  # the block begins with the http head
        digest, seen, chunk = hashlib.sha1(), 0, 0
        while True:
            part = b""
            while left and len(part) < chunk_bytes:
                part += (got := member.upto(min(left, chunk_bytes - len(part))))
                left -= len(got)
            digest.update(part)
            seen += len(part)
            so_far = digest_text(digest.digest())
            if not left and header["WARC-Type"] == "response" and f"sha1:{so_far}" != header["WARC-Payload-Digest"]:
                raise ValueError(f"damaged payload of {header['WARC-Record-ID']}")
            yield header, chunk, part, so_far, seen, not left
            if not left:
                break
            chunk += 1


def read_archives(manifest: DataFrame, bodies: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives: a row per record and chunk, with ``body`` if wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch["archive"].to_pylist()):
            system, target = _folder(path)
            rows, held = [], 0
            with system.open_input_stream(target, compression=None) as stream:
                for header, chunk, body, digest, seen, last in read_chunks(stream, chunk_bytes):
                    page = header.get("Page-ID")
                    rows.append(
                        {
                            "archive": path,
                            "record_id": header["WARC-Record-ID"][1:-1],
                            "chunk": chunk,
                            "record_type": header["WARC-Type"],
                            "page_id": page and int(page),
                            "refers_to_record": header.get("WARC-Refers-To", "<>")[1:-1] or None,
                            "header_digest": header["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "payload_bytes": seen,
                            "payload_digest": digest,
                            "last": last,
                        }
                        | ({"body": body} if bodies else {})
                    )
                    held += 500 + len(body) * bodies
                    if held >= 4 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, arrow)

    schema = CHUNKS + (", body binary" if bodies else "")
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    archives = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return archives.mapInArrow(read, schema)


def resolved(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits through the records they refer to."""
    ends = materialise(chunks.where("last").drop("body"), "warc-records")
    revisits = ends.where("record_type = 'revisit'").select("page_id", "header_digest", F.col("refers_to_record").alias("record_id"))
    wanted = revisits.select("record_id").distinct()
    originals = ends.where("record_type = 'response'").join(wanted, "record_id", "left_semi").select(
        "record_id", F.col("page_id").alias("refers_to"), "payload_bytes"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = ends.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    originals = materialise(originals, "warc-originals")
    through = join_lookup(revisits, originals, ["record_id"], F.struct("page_id", "header_digest"), "left")
    through = through.withColumn("payload_digest", F.col("header_digest")).withColumn("record_type", F.lit("revisit"))
    return own.select(*columns).unionByName(through.select(*columns))
