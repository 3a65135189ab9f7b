"""Named numpy arrays in one file that can be memory-mapped."""

from __future__ import annotations

import json
import mmap
from functools import lru_cache

import numpy as np

from rulespan.shared import _local, open_ranges, write_file

ALIGN = 64


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Returns the bytes written. An array of size 0 is kept as such."""
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, a.size, at]
        pad = -a.nbytes % ALIGN
        parts += [a.tobytes(), b"\0" * pad]
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    write_file(uri, [len(text).to_bytes(8, "little"), text, *parts])
    return at + len(text) + 8


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file: mapped where the folder is a mounted one, else read whole."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:  # the map holds no descriptor
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    with open_ranges(uri) as f:
        return np.frombuffer(f.read(), np.uint8)


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    raw = map_file(uri)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, size, at) in head.items():
        kind = np.dtype(kind)
        at += 8 + n
        out[name] = raw[at : at + size * kind.itemsize].view(kind)
    return out


@lru_cache(maxsize=4096)
def mapped(uri: str) -> dict[str, np.ndarray]:
    return load_arrays(uri)


@lru_cache(maxsize=256)
def mapped_file(uri: str) -> np.ndarray:
    return map_file(uri)


def pack_planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes; those that are all zero are left out, and told by the first byte."""
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T
    used = [k for k in range(width) if planes[k].any()]
    return bytes([sum(1 << k for k in used)]) + len(x).to_bytes(4, "little") + b"".join(planes[k].tobytes() for k in used)


def unpack_planes(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n, at = int.from_bytes(blob[1:5], "little"), 5
    out = np.zeros((n, kind.itemsize), np.uint8)
    for k in range(kind.itemsize):
        if blob[0] >> k & 1:
            out[:, k] = np.frombuffer(blob, np.uint8, n, at)
            at += n
    return out.view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys by their differences, of which the high planes are zero."""
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, np.uint64), dtype=np.uint64)
