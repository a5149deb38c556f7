"""Event files: framing, checksums, damage."""

import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from pixquill.sources import eventlog, sinks

SCHEMA = "run string, tag string, step bigint, value double, wall_time double"


def test_checksum_of_the_standard_text():
    masked = eventlog.masked_crc(b"123456789")
    plain = (masked - eventlog.MASK) & 0xFFFFFFFF
    assert (plain << 15 | plain >> 17) & 0xFFFFFFFF == 0xE3069283


def test_bytes_of_a_known_record():
    # length 1, its checksum, the byte, its checksum
    assert eventlog.frame(b"\x00")[:8] == struct.pack("<Q", 1) and len(eventlog.frame(b"\x00")) == 17
    assert eventlog.event(3, 1.5, "a", 0.5) == bytes.fromhex("09000000000000f83f" "1003" "2a0a" "0a08" "0a0161" "150000003f")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(max_size=8), st.floats(width=32, allow_nan=False)), max_size=6))
def test_scalars_come_back(rows):
    content = b"".join(eventlog.frame(eventlog.event(s, 2.5, t, v)) for s, t, v in rows)
    got = [x for data in eventlog.records(content) for x in eventlog.scalars_of(data)]
    assert got == [(s, 2.5, t, v) for s, t, v in rows]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(1, 255))
def test_any_flipped_byte_is_noticed(at, flip):
    parts = [eventlog.frame(eventlog.event(s, 1.0, "tag", float(s))) for s in range(8)]
    content = bytearray(b"".join(parts))
    at %= len(content)
    content[at] ^= flip
    kept = [d for d in eventlog.records(bytes(content)) if d is not None]
    assert None in list(eventlog.records(bytes(content)))
    whole = [eventlog.event(s, 1.0, "tag", float(s)) for s in range(8)]
    hit = at // len(parts[0])
    # a broken length ends the file, other damage costs its record
    assert kept in (whole[:hit], whole[:hit] + whole[hit + 1 :])


def test_files_of_runs(spark, path):
    rows = [(f"r{i % 2}", ["loss", "rate"][i % 3 == 0], i, i / 7, 100.0 + i) for i in range(200)]
    rows += [("r0", None, 1, 1.0, 1.0), (None, "loss", 1, 1.0, 1.0), ("r0", "loss", 1, None, 1.0), ("r1", "loss", 5, 2.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert eventlog.write_event_files(df, path, rows=30) >= 6
    single = lambda v: struct.unpack("<f", struct.pack("<f", v))[0]
    want = sorted((r, t, s, single(v), w) for r, t, s, v, w in rows if None not in (r, t, v))
    assert sorted(map(tuple, eventlog.read_event_files(spark, path).collect())) == want
    assert sorted(map(tuple, eventlog.read_event_files(spark, path, "rate").collect())) == [w for w in want if w[1] == "rate"]
    assert all(r["damaged"] == 0 for r in eventlog.damaged_records(spark, path).collect())


def test_damaged_files(spark, path):
    good = [eventlog.frame(eventlog.event(s, 1.0, "t", 1.0)) for s in range(3)]
    files = {
        "a.events.out.tfevents.1": b"".join(good), "b.events.out.tfevents.1": b"".join(good)[:-3], "c.events.out.tfevents.1": b"no event file at all",
        "d.events.out.tfevents.1": b"", "e.events.out.tfevents.1": good[0] + eventlog.frame(b"\x2a\x7f") + good[1], "f.txt": b"".join(good),
    }
    sinks.write_files(spark.createDataFrame(list(files.items()), "name string, content binary"), path)
    got = {r["name"][0]: (r["scalars"], r["damaged"]) for r in eventlog.damaged_records(spark, path).collect()}
    assert got == {"a": (3, 0), "b": (2, 1), "c": (0, 1), "e": (2, 1)}
    assert eventlog.read_event_files(spark, path).count() == 7
