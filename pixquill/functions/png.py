"""PNG files from pixels."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type by channels: grey, RGB, RGB with transparency.
COLOURS = {1: 0, 3: 2, 4: 6}


def encode(data: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """A PNG of rows of pixels, eight bits a channel; what the data has beyond them is left out."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    stride = width * channels
    if len(data) < stride * height:
        raise ValueError(f"{len(data)} bytes are too few for {width} x {height} x {channels}")
    rows = b"".join(b"\0" + data[y * stride : (y + 1) * stride] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOURS[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def encoded(data: Column | str, width: Column | str, height: Column | str, channels: int = 3) -> Column:
    """PNG bytes of pixel rows; null where a part is null."""

    @F.pandas_udf("binary")
    def run(data_: pd.Series, width_: pd.Series, height_: pd.Series) -> pd.Series:
        parts = zip(data_, width_, height_)
        return pd.Series([None if d is None or pd.isna(w) or pd.isna(h) else encode(d, int(w), int(h), channels) for d, w, h in parts], dtype=object)

    return run(col(data), col(width), col(height))
