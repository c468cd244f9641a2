"""Arrays as compressed bytes, for rows that carry many values through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    """The values' bytes by significance, compressed: high bytes are mostly alike."""
    x = np.ascontiguousarray(x).ravel()
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)
