"""Arrays of numbers as compact binary cells: byte planes, compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<2sQQ")


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays one after another. Bytes of equal weight lie together, so small numbers cost little."""
    out, compress = [], zstandard.ZstdCompressor(level=1).compress
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        data = compress(planes)
        out += [_HEAD.pack(f"{a.dtype.kind}{a.itemsize}".encode(), len(a), len(data)), data]
    return b"".join(out)


def unpack(cell: bytes) -> list[np.ndarray]:
    at, out, decompress = 0, [], zstandard.ZstdDecompressor().decompress
    while at < len(cell):
        kind, n, size = _HEAD.unpack_from(cell, at)
        at += _HEAD.size
        dtype = np.dtype(f"<{kind.decode()}")
        planes = np.frombuffer(decompress(cell[at:at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def pack_repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their indices: for floats of which many are equal."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, at.astype(np.uint32)
