"""Pixel work: RGB conversion, bicubic resampling, crop and pad."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from .. import constants as K
from .corpus import image_plan

ROWS_PER_BATCH = 32  # raw pixels are large: keep what leaves Python at once small
OUTPUT = "identifier string, width int, height int, action string, data binary"


@lru_cache(maxsize=256)
def cubic_taps(source: int, target: int):
    """Source indices and weights (both target x taps) of a bicubic resize.

    The kernel (a = -0.5) is widened by the scale when shrinking, so the filter
    averages; taps outside the image get weight zero and the rest is normalised.
    """
    import numpy as np

    scale = source / target
    spread = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    first = np.floor(centers - 2 * spread).astype(int)
    index = first[:, None] + np.arange(int(4 * spread) + 3)[None, :]
    x = np.abs(index + 0.5 - centers[:, None]) / spread
    a = -0.5
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = a * (((x - 5) * x + 8) * x - 4)
    w = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    w = np.where((index >= 0) & (index < source), w, 0.0)
    return np.clip(index, 0, source - 1), w / w.sum(axis=1, keepdims=True)


def _resize_columns(values, target: int):
    """Resize the second axis of an H x W x C float array."""
    import numpy as np

    index, weights = cubic_taps(values.shape[1], target)
    out = np.zeros((values.shape[0], target, values.shape[2]))
    for tap in range(index.shape[1]):
        out += weights[None, :, tap, None] * values[:, index[:, tap], :]
    return np.clip(np.floor(out + 0.5), 0, 255)


def resize(pixels, width: int, height: int):
    """Bicubic resize of an H x W x 3 uint8 array, columns first, then rows."""
    import numpy as np

    out = pixels.astype(np.float64)
    if width != pixels.shape[1]:
        out = _resize_columns(out, width)
    if height != pixels.shape[0]:
        out = _resize_columns(out.transpose(1, 0, 2), height).transpose(1, 0, 2)
    return out.astype(np.uint8)


def to_rgb(data: bytes, width: int, height: int, channels: int):
    """H x W x 3 RGB array from the image source's grey, BGR or BGRA bytes."""
    import numpy as np

    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return np.ascontiguousarray(pixels[:, :, 2::-1])


def apply_plan(pixels, action: str, scaled_w: int, scaled_h: int, x: int, y: int, size: int):
    import numpy as np

    scaled = resize(pixels, scaled_w, scaled_h)
    if action == "crop":
        return scaled[y : y + size, x : x + size]
    canvas = np.zeros((size, size, 3), dtype=np.uint8)
    canvas[y : y + scaled_h, x : x + scaled_w] = scaled
    return canvas


def resample_images(
    images: DataFrame,
    size: int = K.IMAGE_SIZE,
    threshold: float = K.CROP_THRESHOLD,
    transforms: list[Callable] | None = None,
) -> DataFrame:
    """Square RGB images from decoded ones (identifier, width, height,
    n_channels, data).

    Geometry is computed in columns; the pixel step reads it.  ``transforms``
    replaces the pixel step for cropped images by a list of array functions.
    Images whose plan is not valid are left out.
    """
    plan = image_plan(images, size, threshold, "width", "height").where("valid")
    needed = [
        "identifier", "width", "height", "n_channels", "data", "action",
        "scaled_w", "scaled_h", "offset_x", "offset_y",
    ]

    def one(r):
        pixels = to_rgb(r.data, r.width, r.height, r.n_channels)
        if transforms and r.action == "crop":
            for fn in transforms:
                pixels = fn(pixels)
        else:
            pixels = apply_plan(pixels, r.action, r.scaled_w, r.scaled_h, r.offset_x, r.offset_y, size)
        return r.identifier, pixels.shape[1], pixels.shape[0], r.action, pixels.tobytes()

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for start in range(0, len(pdf), ROWS_PER_BATCH):
                done = [one(r) for r in pdf.iloc[start : start + ROWS_PER_BATCH].itertuples(index=False)]
                yield pd.DataFrame(done, columns=["identifier", "width", "height", "action", "data"])

    return plan.select(*needed).mapInPandas(run, OUTPUT)
