"""PNG files for tests, without an image library."""

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """Encode an H x W x 3 (or H x W) uint8 array."""
    grey = pixels.ndim == 2
    height, width = pixels.shape[:2]

    def chunk(kind: bytes, data: bytes) -> bytes:
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if grey else 2, 0, 0, 0)
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )


def ramp(width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([x % 256, y % 256, (x + y) % 256], axis=2).astype(np.uint8)
