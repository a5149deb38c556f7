"""WARC archives as seekable Zstandard bundles.

A bundle is the content of one ``.warc.zst`` file: records grouped into frames
that decompress on their own, and a last skippable frame with the seek table of
the Zstandard seekable format.  An index maps each record identifier to bundle,
frame and offset inside the frame, so one record costs one frame.

Bundles are rows of a table in the shared folder: tasks write and read them
through Spark only, wherever that folder is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import materialize
from .common import SLICE_BYTES, broadcast_if_small, col, pick, slices

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-page")

SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle string, content binary, index array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>"
RECORDS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_digest string, payload_bytes bigint, payload binary, bundle string, frame int, offset bigint"
)


# --- records ------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, payload: bytes) -> str:
    """Stable identifier of a page's record; a page without id is named by its payload."""
    name = f"page:{page_id}" if page_id is not None else f"payload:{digest32(payload)}"
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """(identifier, bytes) of a response, or of a revisit if ``refers_to`` names another page."""
    name, digest = record_name(page_id, payload), digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {record_name(refers_to, payload)}",
            f"X-Refers-To-Page-Id: {refers_to}",
            f"WARC-Profile: {REVISIT_PROFILE}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields after the first line at ``at``, and where the block starts."""
    end = data.index(b"\r\n\r\n", at)
    fields = data[at:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}, end + 4


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where the next one starts; a payload that fails its digest is refused."""
    head, start = _headers(data, at)
    end = start + int(head["content-length"])
    http, body = _headers(data, start)
    kind = head["warc-type"]
    payload = data[body:end] if kind == "response" else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (digest32(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"record {head['warc-record-id']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    found = {
        "record_id": head["warc-record-id"], "page_id": number("x-page-id"), "url": head["warc-target-uri"],
        "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload_digest": digest,
        "payload_bytes": int(http["content-length"]), "payload": payload,
    }
    return found, end + 4


# --- bundles ------------------------------------------------------------------


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames with their raw sizes as one bundle, the seek table last."""
    entries = b"".join(struct.pack("<II", len(packed), raw) for packed, raw in frames)
    table = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(p for p, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, read from the end of the bundle."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    first = len(bundle) - 9 - count * width
    out, start = [], 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", bundle, first + k * width)
        out.append((start, packed, raw))
        start += packed
    return out


def frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, raw = place
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=max(raw, 1))


class Bundler:
    """Collects records into frames and frames into bundles of bounded size."""

    def __init__(self, prefix: str):
        self.prefix, self.made = prefix, 0
        self.pack = zstandard.ZstdCompressor(level=3)
        self._clear()

    def _clear(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[dict] = []
        self.raw = bytearray()
        self.size = 0

    def _close_frame(self) -> None:
        if self.raw:
            packed = self.pack.compress(bytes(self.raw))
            self.frames.append((packed, len(self.raw)))
            self.size += len(packed)
            self.raw = bytearray()

    def add(self, page_id: int | None, name: str, data: bytes) -> dict | None:
        """Takes a record; gives a bundle when one is full."""
        self.index.append(
            {"record_id": name, "page_id": page_id, "frame": len(self.frames), "offset": len(self.raw), "length": len(data)}
        )
        self.raw += data
        if len(self.raw) >= FRAME_BYTES:
            self._close_frame()
        return self.close() if self.size >= BUNDLE_BYTES else None

    def close(self) -> dict | None:
        self._close_frame()
        if not self.frames:
            return None
        out = {"bundle": f"{self.prefix}-{self.made:05d}.warc.zst", "content": seal(self.frames), "index": self.index}
        self.made += 1
        self._clear()
        return out


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_BUNDLE_SCHEMA = pa.schema(
    [
        ("bundle", pa.string()), ("content", pa.binary()),
        ("index", pa.list_(pa.struct([
            ("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
        ]))),
    ]
)
_RECORD_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()),
    ]
)


# --- tables -------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) plus ``refers_to``: the page whose payload it repeats.

    Of equal payloads of ``least_bytes`` or more, the largest page_id is written
    in full and the others refer to it; pages without id are always written in
    full.  Payloads are compared by SHA-1; only identifiers and digests travel,
    pages stay where they are unless the revisits outgrow a broadcast.
    """
    value = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select("page_id", F.sha1(value).alias("sha1")).where(
        F.col("page_id").isNotNull() & (F.octet_length(value) >= least_bytes)
    )
    # most payloads are alone: only those that repeat are joined
    chosen = narrow.groupBy("sha1").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("least"))
    repeated = chosen.where("least < keep").select("sha1", "keep")
    # a third of all pages may be one error page
    revisits = skew_join(narrow, repeated, "sha1").where("page_id < keep").select("page_id", "sha1", "keep").distinct()
    revisits = broadcast_if_small(materialize(revisits, "revisits"))
    joined = pages.withColumn("sha1", F.sha1(value)).join(revisits, ["page_id", "sha1"], "left")
    return joined.select("page_id", "url", "html", F.col("keep").alias("refers_to"))


def write_bundles(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> DataFrame:
    """``bundle, content, index``: the archives, one row per bundle, in the shared folder.

    A null url is written as ``about:blank``, a null html as an empty payload.
    Repeated rows get a record each.  No pages give no bundles.
    """
    rows = with_revisits(pick(pages, page_id=page_id, url=url, html=html).withColumn("page_id", col("page_id").cast("bigint")), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(f"part-{TaskContext.get().partitionId():06d}")
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                name, data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])
                if full := bundler.add(row["page_id"], name, data):
                    yield _rows([full], _BUNDLE_SCHEMA)
        if last := bundler.close():
            yield _rows([last], _BUNDLE_SCHEMA)

    return materialize(rows.mapInArrow(run, BUNDLES), "bundles")


def index_of(bundles: DataFrame) -> DataFrame:
    """``record_id, page_id, bundle, frame, offset, length`` of every record."""
    return bundles.select("bundle", F.explode("index").alias("i")).select(
        "i.record_id", "i.page_id", "bundle", "i.frame", "i.offset", "i.length"
    )


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, parsed frame by frame (payload null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                out, held = [], 0
                for k, where in enumerate(seek_table(data)):
                    raw, at = frame(data, where), 0
                    while at < len(raw):
                        found, end = parse(raw, at)
                        out.append(found | {"bundle": name.as_py(), "frame": k, "offset": at})
                        at = end
                    held += len(raw)
                    if held >= SLICE_BYTES:
                        yield _rows(out, _RECORD_SCHEMA)
                        out, held = [], 0
                if out:
                    yield _rows(out, _RECORD_SCHEMA)

    return bundles.select("bundle", "content").mapInArrow(run, RECORDS)


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named in ``wanted`` (record_id), decompressing only the frames that hold them."""
    places = index_of(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    grouped = places.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, last, raw = seek_table(row["content"]), -1, b""
                for place in row["places"]:
                    if place["frame"] != last:
                        last, raw = place["frame"], frame(row["content"], table[place["frame"]])
                    found, _ = parse(raw, place["offset"])
                    yield _rows([found | {"bundle": row["bundle"], **place}], _RECORD_SCHEMA)

    return bundles.select("bundle", "content").join(grouped, "bundle").mapInArrow(run, RECORDS)
