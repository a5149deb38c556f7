"""Crop / pad geometry of an image as columns of its original size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col


def aspect_ratio(width: Column | str, height: Column | str) -> Column:
    w, h = col(width), col(height)
    return F.try_divide(F.least(w, h).cast("double"), F.greatest(w, h).cast("double"))


def action(width, height, threshold: float = K.CROP_THRESHOLD) -> Column:
    """"crop" at or above the threshold, "pad" below, null for unknown sizes."""
    ratio = aspect_ratio(width, height)
    return F.when(ratio >= threshold, F.lit("crop")).when(ratio < threshold, F.lit("pad"))


def crop_geometry(width, height, size: int = K.IMAGE_SIZE) -> dict[str, Column]:
    """Resize the short side to ``size``, then cut the centre window.

    The long side is truncated; offsets round half to even.
    """
    w, h = col(width).cast("bigint"), col(height).cast("bigint")
    short, long = F.least(w, h), F.greatest(w, h)
    scaled = F.floor(long * size / short).cast("int")
    new_w = F.when(w <= h, F.lit(size)).otherwise(scaled)
    new_h = F.when(w <= h, scaled).otherwise(F.lit(size))
    return {
        "scaled_w": new_w,
        "scaled_h": new_h,
        "offset_x": F.bround((new_w - size) / F.lit(2.0)).cast("int"),
        "offset_y": F.bround((new_h - size) / F.lit(2.0)).cast("int"),
    }


def pad_geometry(width, height, size: int = K.IMAGE_SIZE) -> dict[str, Column]:
    """Scale the longest side to ``size`` and centre on a square canvas.

    Both sides go through double arithmetic and truncate, so an exact fit may
    come out one pixel short, and a very thin side may vanish.
    """
    w, h = col(width), col(height)
    scale = F.lit(float(size)) / F.greatest(w, h).cast("double")
    new_w = (w.cast("double") * scale).cast("int")
    new_h = (h.cast("double") * scale).cast("int")
    return {
        "scaled_w": new_w,
        "scaled_h": new_h,
        "offset_x": F.floor((F.lit(size) - new_w) / 2).cast("int"),
        "offset_y": F.floor((F.lit(size) - new_h) / 2).cast("int"),
    }
