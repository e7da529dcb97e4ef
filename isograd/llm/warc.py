"""Web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some WARC records, and a skippable
frame at its end with the sizes of all frames: the seek table. Where a record lies is kept in a table:
bundle, frame, and offset inside the frame. So a record is read by decompressing one frame.

Bundles are written by tasks under names of their own; only names that a finished task returned are in
the table, so a task that is lost and run again leaves at most an unused file. Files are opened through
``pyarrow.fs`` by URI, in the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import written
from isograd.session import scratch

# Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Uncompressed bytes of a frame and of a bundle; a longer record has a frame of its own.
FRAME, BUNDLE = 256 << 10, 64 << 20
#: Smaller payloads are always stored.
SMALLEST = 100
_INDEX = "page_id {}, bundle string, frame long, offset long, length long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, uncompressed) sizes of all frames."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    body += struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * entry)
    raw, out, at = file.read(count * entry), [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", raw, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record without the payload."""
    revisit = refers_to is not None
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{name}>"),
            ("WARC-Target-URI", " ".join((url or "").split())),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-Id", "" if page_id is None else str(page_id)),
            ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-Id", str(refers_to))]
    body = b"" if revisit else payload
    head.append(("Content-Length", str(len(body))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset behind it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                for line in lines[1:])
    low = end + 4
    high = low + int(head["Content-Length"])
    return head, data[low:high], high + 4


class _Bundle:
    """Collects records to frames and frames to a file."""

    def __init__(self, folder: str):
        store, path = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.pending, self.size, self.total = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.pending and self.size + len(data) > FRAME:
            self.flush()
        place = len(self.frames), self.size
        self.pending.append(data)
        self.size += len(data)
        self.total += len(data)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def _with_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def first_of_equals(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with _digest and _first: the page_id to refer to, else null.

    The smallest page_id of each payload is found by an aggregation of digests, combined before the
    shuffle, and only payloads that occur more than once are joined back.
    """
    data = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", "html").withColumn("_digest", F.sha2(data, 256))
    keys = (rows.where(F.octet_length("html") >= SMALLEST).groupBy("_digest")
            .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").select(F.col("_digest").alias("_key"), "_first"))
    joined = rows.join(written(keys, "payloads"), F.col("_digest") == F.col("_key"), "left")
    return joined.select("page_id", "url", "html", "_digest",
                         F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
                         .alias("_first"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page into bundles; returns where each record lies.

    Result: page_id, bundle, frame, offset, length (in the uncompressed frame). Null html counts as an
    empty payload, null url as an empty one; rows with a page_id that is null or occurs again get a
    record each. Of equal payloads of at least 100 bytes all but those of the smallest page_id become
    revisits; of rows that repeat that page_id, each is a response. Other columns are not read.
    """
    folder = _with_uri(folder)
    kind = pages.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for page, url, html, digest, first in zip(*(c for c in batch.columns)):
                payload = (html.as_py() or "").encode()
                if bundle is None:
                    bundle = _Bundle(folder)
                page = page.as_py()
                data = record(page, url.as_py(), payload, digest.as_py(), first.as_py())
                rows.append((page, bundle.name, *bundle.add(data), len(data)))
                if bundle.total >= BUNDLE:
                    bundle.close()
                    yield _rows(rows)
                    bundle, rows = None, []
        if bundle is not None:
            bundle.close()
            yield _rows(rows)

    def _rows(rows) -> pa.RecordBatch:
        kinds = [pa.int64() if kind in ("bigint", "int") else pa.string(), pa.string(),
                 *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["page_id", "bundle", "frame", "offset", "length"])

    return written(first_of_equals(pages).mapInArrow(write, _INDEX.format(
        kind if kind in ("bigint", "string") else "bigint")), "records")


_RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


def _row(head: dict[str, str], block: bytes) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    page, first = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
    return (int(page) if page else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"],
            int(first) if first else None, block)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=[f.split()[0] for f in _RECORD.split(", ")])


def _tasks(index: DataFrame) -> int:
    """A task per bundle; an explicit number, as adaptive execution would join the few names to one task."""
    return max(1, index.agg(F.countDistinct("bundle")).first()[0])


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the table names, frame by frame.

    Digests are computed anew from the payloads read and must equal those in the headers.
    """
    folder = _with_uri(folder)
    names = index.select("bundle").distinct().repartition(_tasks(index), "bundle")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                with store.open_input_file(path) as file:
                    for at, packed, plain in read_seek_table(file):
                        file.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(
                            file.read(packed), max_output_size=plain)
                        rows, low = [], 0
                        while low < len(data):
                            head, block, low = parse(data, low)
                            rows.append(_row(head, block))
                        yield _batch(rows)

    return names.mapInArrow(read, _RECORD)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the table's rows alone: only their frames are read and decompressed."""
    folder = _with_uri(folder)
    places = (index.repartition(_tasks(index), "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
              .select("bundle", "frame", "offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, frame, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                with store.open_input_file(path) as file:
                    at, packed, plain = read_seek_table(file)[frame]
                    file.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(
                        file.read(packed), max_output_size=plain)
                yield _batch([_row(*parse(data, low)[:2]) for low in offsets])

    return places.mapInArrow(read, _RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives read back."""
    folder = scratch(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_archives(index, folder).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
