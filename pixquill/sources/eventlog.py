"""Scalar logs as event files: framed records with masked checksums.

A record is its length (8 bytes, little-endian), the checksum of these, the data
and the checksum of the data.  The data is an event message: wall time (field 1,
double), step (field 2), file version (field 3) or summary (field 5), whose values
(field 1) have a tag (field 1) and a number (field 2, float).  Other fields are
passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_files

#: Rows of a run that one file holds at most.
ROWS_PER_FILE = 100_000
EVENT_GLOB = "*.tfevents*"
#: The Castagnoli polynomial, reversed, and what masks a checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
VERSION = "brain.Event:2"


def _table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return out


TABLE = _table()


def masked_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked_crc(size)) + data + struct.pack("<I", masked_crc(data))


def records(content: bytes) -> Iterator[bytes | None]:
    """The data of each record; None for one whose data do not fit their checksum, and for an end that is no record."""
    at = 0
    while at < len(content):
        head = content[at : at + 12]
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
            yield None  # where the next record begins is not known
            return
        end = at + 12 + struct.unpack("<Q", head[:8])[0]
        data, check = content[at + 12 : end], content[end : end + 4]
        yield data if len(check) == 4 and struct.unpack("<I", check)[0] == masked_crc(data) else None
        at = end + 4


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _sized(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def event(step: int, wall_time: float, tag: str | None = None, value: float | None = None) -> bytes:
    """The message of one scalar, or without a tag that of the head of a file."""
    out = b"\x09" + struct.pack("<d", wall_time) + b"\x10" + _varint(step)
    if tag is None:
        return out + _sized(3, VERSION.encode())
    return out + _sized(5, _sized(1, _sized(1, tag.encode()) + b"\x15" + struct.pack("<f", value)))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message; numbers of fixed size as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at += 1
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise IndexError("a field goes beyond its message")
        yield key >> 3, data[at : at + size]
        at += size


def scalars_of(data: bytes) -> list[tuple[int, float, str, float]]:
    """(step, wall time, tag, value) of the scalars of an event."""
    step, wall_time, found = 0, 0.0, []
    for field, value in _fields(data):
        if field == 1:
            wall_time = struct.unpack("<d", value)[0]
        elif field == 2:
            step = value - (1 << 64) if value >> 63 else value
        elif field == 5:
            for part, item in _fields(value):
                parts = dict(_fields(item)) if part == 1 else {}
                if 1 in parts and 2 in parts:
                    found.append((parts[1].decode(), struct.unpack("<f", parts[2])[0]))
    return [(step, wall_time, tag, value) for tag, value in found]


# --- tables ---------------------------------------------------------------------


def event_contents(scalars: DataFrame, rows: int = ROWS_PER_FILE) -> DataFrame:
    """``run, name, content``: event files of a scalar table (run, tag, step, value, wall_time).

    A run is cut by steps into files of about ``rows`` scalars, in the order of steps; a
    null value or tag has no event.
    """
    usable = scalars.where("run is not null and tag is not null and value is not null and step is not null")
    sizes = usable.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("low"), F.max("step").alias("high"))
    files = F.ceil(F.col("n") / rows)
    place = F.floor((F.col("step") - F.col("low")) * files / (F.col("high") - F.col("low") + 1)).cast("int")
    placed = usable.join(F.broadcast(sizes), "run").select("run", "tag", "step", "value", "wall_time", place.alias("part"))

    def run(key, pdf):
        import pandas as pd

        name, part = key
        rows_ = pdf.sort_values(["step", "tag", "wall_time", "value"])
        start = float(rows_["wall_time"].iloc[0])
        body = [frame(event(0, start))]
        body += [frame(event(int(s), w, t, v)) for s, w, t, v in zip(rows_["step"], rows_["wall_time"], rows_["tag"], rows_["value"])]
        return pd.DataFrame({"run": [name], "name": [f"events.out.tfevents.{part:06d}"], "content": [b"".join(body)]})

    return placed.groupBy("run", "part").applyInPandas(run, "run string, name string, content binary")


def write_event_files(scalars: DataFrame, path: str, rows: int = ROWS_PER_FILE, opener=None) -> int:
    """Event files of a scalar table, named after run and part, under ``path``; gives their number."""
    named = event_contents(scalars, rows).select(F.concat("run", F.lit("."), "name").alias("name"), "content")
    return write_files(named, path, opener)


def _parsed(files: DataFrame) -> DataFrame:
    """``name, kind, tag, step, value, wall_time``: scalars, and a row without a tag for each other or damaged record."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"]):
                out = []
                for data in records(bytes(content)):
                    try:
                        found = None if data is None else scalars_of(data)
                    except (IndexError, KeyError, UnicodeDecodeError, struct.error):
                        found = None  # well framed, but no event
                    if found is None:
                        out.append((name, "damaged", None, None, None, None))
                    elif not found:
                        out.append((name, "other", None, None, None, None))
                    else:
                        out += [(name, "scalar", tag, step, value, wall_time) for step, wall_time, tag, value in found]
                yield pd.DataFrame(out, columns=["name", "kind", "tag", "step", "value", "wall_time"]).astype({"step": "Int64"})

    schema = "name string, kind string, tag string, step bigint, value double, wall_time double"
    return files.select("name", "content").mapInPandas(run, schema)


def read_event_contents(files: DataFrame, tag: str | None = None) -> DataFrame:
    """``name, tag, step, value, wall_time`` of the scalars in files (name, content), of one tag if given."""
    found = _parsed(files).where("kind = 'scalar'").drop("kind")
    return found.where(F.col("tag") == tag) if tag else found


def event_files(spark: SparkSession, path: str, glob: str = EVENT_GLOB) -> DataFrame:
    """``run, name, content`` of the event files under ``path``, each read by one task; ``run`` is what stands before the file's own name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract(name, r"^(.*?)\.?events\.out\.", 1).alias("run"), name.alias("name"), "content")


def read_event_files(spark: SparkSession, path: str, tag: str | None = None, glob: str = EVENT_GLOB) -> DataFrame:
    """``run, tag, step, value, wall_time`` of the event files under ``path``; damaged records are left out."""
    found = read_event_contents(event_files(spark, path, glob), tag)
    run = F.regexp_extract("name", r"^(.*?)\.?events\.out\.", 1).alias("run")
    return found.select(run, "tag", "step", "value", "wall_time")


def damaged_records(spark: SparkSession, path: str, glob: str = EVENT_GLOB) -> DataFrame:
    """``name, scalars, damaged`` per event file: its scalars, and records that do not fit their checksums or are cut off."""
    kinds = _parsed(event_files(spark, path, glob)).groupBy("name")
    return kinds.agg(F.count_if(F.col("kind") == "scalar").alias("scalars"), F.count_if(F.col("kind") == "damaged").alias("damaged"))
