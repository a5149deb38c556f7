"""Encoded image payloads: base64, data URLs, header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def decode_base64(images: Column | str) -> Column:
    """Bytes of the first base64 text of an array; null when absent or bad."""
    return F.try_to_binary(F.try_element_at(col(images), F.lit(1)), F.lit("base64"))


def decode_data_url(url: Column | str) -> Column:
    """Bytes of the part after the first comma of a data URL; null when bad."""
    c = col(url)
    payload = F.when(F.contains(c, F.lit(",")), F.split_part(c, F.lit(","), F.lit(2)))
    return F.try_to_binary(payload, F.lit("base64"))


def _unsigned(data: Column, start: int, length: int, little: bool = False, as_type: str = "int") -> Column:
    """Integer from ``length`` bytes starting at 1-based ``start``."""
    positions = range(start + length - 1, start - 1, -1) if little else range(start, start + length)
    digits = F.concat(*[F.hex(F.substring(data, p, 1)) for p in positions])
    return F.conv(digits, 16, 10).try_cast(as_type)


def _signed(data: Column, start: int) -> Column:
    """Little-endian 32-bit number; top-down bitmaps have a negative height."""
    value = _unsigned(data, start, 4, little=True, as_type="bigint")
    return F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")


def _starts(data: Column, hex_prefix: str) -> Column:
    return F.hex(F.substring(data, 1, len(hex_prefix) // 2)) == hex_prefix


# JPEG marker codes: frame headers carry the size; the others have no length
_FRAME = ["C0", "C1", "C2", "C3", "C5", "C6", "C7", "C9", "CA", "CB", "CD", "CE", "CF"]
_BARE = ["01", "D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8"]
_LAST = ["D9", "DA"]
_USUAL_SEGMENTS = 1024


def _jpeg_size(data: Column) -> Column:
    """struct(pos, w, h, done) after walking the segments of a JPEG."""
    def number(pos: Column) -> Column:
        return F.conv(F.hex(F.substring(data, pos, F.lit(2))), 16, 10).cast("int")

    def state(pos: Column, w: Column, h: Column, done: bool) -> Column:
        return F.struct(pos.alias("pos"), w.alias("w"), h.alias("h"), F.lit(done).alias("done"))

    nothing = F.lit(None).cast("int")

    def step(s: Column, _: Column) -> Column:
        pos = s["pos"]
        lead = F.hex(F.substring(data, pos, F.lit(1)))
        code = F.hex(F.substring(data, pos + 1, F.lit(1)))
        return (
            F.when(s["done"], s)
            .when((lead != "FF") | (code == "") | code.isin(_LAST), state(pos, nothing, nothing, True))
            .when(code == "FF", state(pos + 1, nothing, nothing, False))
            .when(code.isin(_FRAME), state(pos, number(pos + 7), number(pos + 5), True))
            .when(code.isin(_BARE), state(pos + 2, nothing, nothing, False))
            .otherwise(state(pos + 2 + F.coalesce(number(pos + 2), F.lit(0)), nothing, nothing, False))
        )

    start = state(F.lit(3), nothing, nothing, False)
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(_USUAL_SEGMENTS)), start, step)
    # a segment takes at least two bytes, so this walk reaches the end of any file
    whole = F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), start, step)
    return F.when(usual["done"], usual).otherwise(whole)


_USUAL_BOXES = 64


def _avif_size(data: Column) -> Column:
    """struct(pos, w, h, done) after walking the nested boxes of an AVIF file.

    The walk steps into ``meta``, ``iprp`` and ``ipco`` and over all other boxes.
    Of several sizes (thumbnails, tiles, transparency) the one of the largest area counts.
    """

    def number(pos: Column, n: int = 4) -> Column:
        return F.conv(F.hex(F.substring(data, pos.cast("int"), F.lit(n))), 16, 10).try_cast("bigint")

    def state(pos: Column, w: Column, h: Column, done: Column | bool) -> Column:
        done = F.lit(done) if isinstance(done, bool) else done
        return F.struct(pos.cast("bigint").alias("pos"), w.cast("int").alias("w"), h.cast("int").alias("h"), done.alias("done"))

    nothing = F.lit(None).cast("int")

    def step(s: Column, _: Column) -> Column:
        pos = s["pos"]
        size, kind = number(pos), F.hex(F.substring(data, (pos + 4).cast("int"), F.lit(4)))
        whole = F.when(size == 1, number(pos + 8, 8)).otherwise(size)
        w, h = number(pos + 12), number(pos + 16)
        larger = (kind == "69737065") & (w * h > F.coalesce(s["w"].cast("bigint") * s["h"], F.lit(0)))
        end = F.octet_length(data)
        over = pos + whole
        # a size of 0 means up to the end; one that leads nowhere ends the walk
        stop = F.coalesce((whole < 8) | (over > end), F.lit(True))
        return (
            F.when(s["done"], s)
            .when(F.length(kind) < 8, state(pos, s["w"], s["h"], True))
            .when(kind == "6D657461", state(pos + 12, s["w"], s["h"], False))
            .when(kind.isin("69707270", "6970636F"), state(pos + 8, s["w"], s["h"], False))
            .otherwise(state(F.coalesce(over, pos), F.when(larger, w).otherwise(s["w"]), F.when(larger, h).otherwise(s["h"]), stop))
        )

    start = state(F.lit(1), nothing, nothing, False)
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(_USUAL_BOXES)), start, step)
    # a box takes at least eight bytes, so this walk reaches the end of any file
    every = F.aggregate(F.sequence(F.lit(1), F.floor(F.octet_length(data) / 8).cast("int") + 1), start, step)
    return F.when(usual["done"], usual).otherwise(every)


def _is_avif(data: Column) -> Column:
    """Whether the file type box names the AVIF brands."""
    brands = F.hex(F.substring(data, 9, 64))
    return (F.hex(F.substring(data, 5, 4)) == "66747970") & (F.contains(brands, F.lit("61766966")) | F.contains(brands, F.lit("61766973")))


def header_size(data: Column | str) -> tuple[Column, Column]:
    """(width, height) read from a PNG, JPEG, GIF, BMP, WebP or AVIF header; null for
    anything else."""
    d = col(data)
    avif, boxes = _is_avif(d), _avif_size(d)
    png, gif, bmp = _starts(d, "89504E470D0A1A0A"), _starts(d, "474946"), _starts(d, "424D")
    jpeg = _starts(d, "FFD8FF")
    frame = _jpeg_size(d)
    riff = _starts(d, "52494646") & (F.hex(F.substring(d, 9, 4)) == "57454250")
    kind = F.hex(F.substring(d, 13, 4))
    lossy, lossless, extended = riff & (kind == "56503820"), riff & (kind == "5650384C"), riff & (kind == "56503858")
    packed = _unsigned(d, 22, 4, little=True, as_type="bigint")
    width = (
        F.when(png, _unsigned(d, 17, 4))
        .when(jpeg, frame["w"])
        .when(avif, boxes["w"])
        .when(gif, _unsigned(d, 7, 2, little=True))
        .when(bmp, _unsigned(d, 19, 4, little=True))
        .when(lossy, _unsigned(d, 27, 2, little=True).bitwiseAND(0x3FFF))
        .when(lossless, (packed.bitwiseAND(0x3FFF) + 1).cast("int"))
        .when(extended, _unsigned(d, 25, 3, little=True) + 1)
    )
    height = (
        F.when(png, _unsigned(d, 21, 4))
        .when(jpeg, frame["h"])
        .when(avif, boxes["h"])
        .when(gif, _unsigned(d, 9, 2, little=True))
        .when(bmp, F.abs(_signed(d, 23)))
        .when(lossy, _unsigned(d, 29, 2, little=True).bitwiseAND(0x3FFF))
        .when(lossless, (F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1).cast("int"))
        .when(extended, _unsigned(d, 28, 3, little=True) + 1)
    )
    return width, height
