"""MurmurHash3 (x86, 32 bits) of whole string columns, as the hashing vectoriser uses it.

All strings move on together by blocks of four bytes; strings that end drop out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pairfeat.operators.trie import string_parts

# The constants of MurmurHash3 x86_32.
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def _block(k: np.ndarray) -> np.ndarray:
    return _turned(k * np.uint32(C1), 15) * np.uint32(C2)


def murmur3_32(column: pa.Array, seed: int = 0) -> np.ndarray:
    """Signed 32-bit hash of the UTF-8 bytes of each string (no nulls)."""
    offsets, data = string_parts(column)
    start, size = offsets[:-1], np.diff(offsets)
    data = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    h = np.full(len(column), seed, np.uint32)
    active, depth = np.flatnonzero(size >= 4), 0
    while len(active):
        at = start[active] + depth
        k = data[at] | data[at + 1] << np.uint32(8) | data[at + 2] << np.uint32(16) | data[at + 3] << np.uint32(24)
        h[active] = _turned(h[active] ^ _block(k), 13) * np.uint32(5) + np.uint32(ADD)
        depth += 4
        active = active[size[active] >= depth + 4]
    rest, at = size % 4, offsets[1:] - size % 4
    k = np.zeros(len(column), np.uint32)
    for b in range(3):
        k |= np.where(rest > b, data[np.minimum(at + b, len(data) - 1)] << np.uint32(8 * b), np.uint32(0))
    h ^= np.where(rest > 0, _block(k), np.uint32(0))
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX1)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX2)
    return (h ^ (h >> np.uint32(16))).view(np.int32)
