"""WARC archives as seekable Zstandard bundles.

A bundle holds independent frames, each of whole WARC records, and ends with a seek table in a skippable frame
(the public seekable format: an entry for each frame with its compressed and plain size, frame count, descriptor,
footer magic). An index maps each record to its bundle, frame and offset inside the plain frame, so that one record is
read by decompressing one frame. Records whose payload another record holds are revisits without a payload; the index
keeps the length of every payload. All records carry one date, a parameter, so that a repeated write gives equal bytes.

Null html is an empty payload; a null page_id is written as such and never another record's response unless all of
its group are null; rows that repeat the page_id of a response are responses too; an empty table gives no bundles;
columns other than id, url and html are ignored. Equal payloads meet by their digest: one row for each repeated digest
is joined to the pages, which Spark broadcasts where it is small and otherwise splits where a digest is hot. Of pages
that tie in payload the largest page_id is the response. A very long page is a record, and a frame, of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tune, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL, DATE = 1 << 20, 16 << 20, 3, "2000-01-01T00:00:00Z"
#: Fixed values of the seekable format: a skippable frame's magic and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int64())]))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC 1.1 record. A revisit has headers only, and names the record that holds its payload."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of each record of a plain frame. Raises ValueError where a record is cut."""
    at = 0
    while at < len(frame):
        end = frame.find(b"\r\n\r\n", at)
        if end < 0 or not frame.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        if frame[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut")
        yield at, head, frame[end + 4 : stop]
        at = stop + 4


class BundleWriter:
    """add() records, finish() gives the bundle and its index."""

    def __init__(self, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes = frame_bytes
        self.frames, self.sizes, self.index, self.open, self.size, self.total = [], [], [], [], 0, 0

    def add(self, page_id: int | None, data: bytes, length: int) -> None:
        self.index.append((page_id, len(self.frames), self.size, length))
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        packed = self.coder.compress(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.size))
        self.open, self.size = [], 0

    def finish(self) -> tuple[bytes, list[tuple]]:
        if self.open:
            self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer]), self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame."""
    count, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at = len(bundle) - 9 - 8 * count
    if struct.unpack_from("<II", bundle, at - 8) != (SKIPPABLE, 8 * count + 9):
        raise ValueError("the seek table is damaged")
    out, place = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, at + 8 * i)
        out.append((place, packed, plain))
        place += packed
    return out


def frame(bundle: bytes, number: int) -> bytes:
    """One frame, without reading the others."""
    import zstandard

    at, packed, plain = seek_table(bundle)[number]
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(1, plain))
    if len(data) != plain:
        raise ValueError(f"frame {number} has another size than its entry")
    return data


def read_record(bundle: bytes, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an index entry."""
    _, head, body = next(records(frame(bundle, number)[offset:]))
    return head, body


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """bundle (bytes), index (page_id, frame, offset, payload length) for each bundle, from a table in the shared folder."""
    tune(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), payload.alias("h"), F.sha1(payload).alias("d"))
    winners = rows.groupBy("d").agg(F.max("p").alias("w"), F.count("*").alias("n")).where("n > 1").select("d", "w")
    marked = rows.join(winners, "d", "left").select("p", "u", "h", "d", "w")

    def run(batches):
        def row(writer):
            data, index = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([[dict(zip(("page_id", "frame", "offset", "length"), i, strict=True)) for i in index]], _INDEX)], ["bundle", "index"])

        writer = BundleWriter(level, frame_bytes)
        for b in batches:
            for p, u, h, d, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(d)).decode()
                writer.add(p, record(p, u, h, digest, w, w is not None and p != w, date), len(h))
                if writer.total >= bundle_bytes:
                    yield row(writer)
                    writer = BundleWriter(level, frame_bytes)
        if writer.index:
            yield row(writer)

    return written(marked.mapInArrow(run, "bundle binary, index array<struct<page_id: bigint, frame: int, offset: int, length: bigint>>"), "warc", "none")[0]


def read_archive(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record, from the bundles. A payload
    that fails its digest or an index that points elsewhere raises ValueError."""

    def number(name: str | None) -> int | None:
        return None if name is None or name == "<urn:page:null>" else int(name[10:-1])

    def run(batches):
        for b in batches:
            for bundle, index in zip(b.column(0), b.column(1), strict=True):
                data, places, out = bundle.as_py(), index.as_py(), []
                for k in range(len(seek_table(data))):
                    for at, head, body in records(frame(data, k)):
                        place, revisit = places[len(out)], head["WARC-Type"] == "revisit"
                        if (place["frame"], place["offset"], place["page_id"]) != (k, at, number(head["WARC-Record-ID"])):
                            raise ValueError("the index points to another record")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError("a payload fails its digest")
                        if not revisit and place["length"] != len(body):
                            raise ValueError("the index has another length")
                        out.append((place["page_id"], place["length"], digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), head["WARC-Target-URI"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return bundles.select("bundle", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
