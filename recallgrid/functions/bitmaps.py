"""Compressed bitmaps over integer codes, as numpy containers of 2**16 codes each.

A container with few codes is a sorted ``uint16`` array, one with many is 8 KB of bits.
"""

from __future__ import annotations

import numpy as np

BITS = 1 << 16
DENSE_FROM = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) < DENSE_FROM:
        return low.astype(np.uint16)
    flags = np.zeros(BITS, dtype=np.uint8)
    flags[low] = 1
    return np.packbits(flags)


def _is_dense(container: np.ndarray) -> bool:
    return container.dtype == np.uint8


def build(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Bitmap of integer codes; order and repeats don't matter."""
    codes = np.unique(codes)
    out = {}
    high = codes >> 16
    for h in np.unique(high):
        part = codes[np.searchsorted(high, h) : np.searchsorted(high, h, side="right")]
        out[int(h)] = _pack(part & 0xFFFF)
    return out


def _low(container: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(container)).astype(np.uint16) if _is_dense(container) else container


def and_not(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Codes of ``a`` that ``b`` lacks."""
    out = {}
    for h, x in a.items():
        y = b.get(h)
        if y is None:
            out[h] = x
        elif _is_dense(x) and _is_dense(y):
            out[h] = x & ~y
        elif _is_dense(y):
            keep = (y[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
            out[h] = x[keep == 0]
        else:
            out[h] = np.setdiff1d(_low(x), y, assume_unique=True)
    return out


def decode(bitmap: dict[int, np.ndarray]) -> np.ndarray:
    """The codes in ascending order."""
    parts = [_low(c).astype(np.int64) + (h << 16) for h, c in sorted(bitmap.items())]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
