"""Vectorised word and line kernels over Arrow columns of UTF-8 text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0xD6E8FEB86659FD93
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(28))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size + 1, BASE, U), np.full(size + 1, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], equal for equal content wherever it stands (one pass, all spans)."""
    size = 1 << max(18, int(len(codes)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


@dataclass
class Block:
    """Some consecutive rows: `lo` the first, `data` their bytes, `bounds` where each row's bytes begin and end."""

    lo: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of about `limit` bytes (a longer row has its own); null texts are empty."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte spans, hashes, and `first[i]:first[i + 1]`, the words of row i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(block: Block, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """Words are runs of bytes other than `apart` (space and 0x09 to 0x0D); `lower` folds A-Z."""
    data = _LOWER[block.data] if lower else block.data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(starts, stops, span_hashes(data, starts, stops), np.searchsorted(starts, block.bounds))


def shingles(found: Words, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct hashes of `size` words, sorted; a shorter row has one of all its words, an empty row none."""
    h, out = found.hashes, []
    full = max(0, len(h) - size + 1)
    odd = [U((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(1, size + 1)]
    every = np.full(full, U(size))
    for i in range(size):
        every += mix(h[i : i + full] + odd[i]) * odd[i]
    every = mix(every)
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            whole = U(b - a)
            for i in range(b - a):
                whole = whole + mix(h[a + i : a + i + 1] + odd[i]) * odd[i]
            out.append(mix(whole))
        else:
            out.append(h[:0])
    return out
