"""Vectorised word and byte hashing over Arrow string batches.

A slice of documents is one byte buffer; words are found with masks and hashed
eight bytes at a time, so no Python object is made for a word but for very long
ones. Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text forms its own slice.
SLICE_BYTES = 1 << 20

#: Words of more bytes are hashed by BLAKE2.
LONG = 64
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
WINDOW_VALUES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_TAIL = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

#: Ranges are hashed in the field of so many elements: a power of two as modulus would let patterned sequences collide.
FIELD = 2**61 - 1
_MULTIPLIER = 0x16E8FEB86659FD93
_INVERSE = pow(_MULTIPLIER, -1, FIELD)
_P = _U(FIELD)
_powers: dict[int, np.ndarray] = {}
#: Elements that are hashed at a time.
BLOCK = 1 << 13


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each ``buf[start:end]``: a chain that mixes after every eight bytes, and for more than LONG bytes BLAKE2.

    ``seed`` (0 to 255) chooses one of several independent hashes.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + _U(0x9E3779B97F4A7C15) + _U(seed << 56))
    if not len(out):
        return out
    eight = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        if not len(left):
            break
        rest = size[left] - at
        out[left] = mix(out[left] * _U(0xD6E8FEB86659FD93) ^ (eight[starts[left] + at] & _TAIL[np.minimum(rest, 8)]))
        left = left[rest > 8]
    long = np.flatnonzero(size > LONG)
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[i] = int.from_bytes(blake2b(buf[a:b], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo FIELD."""
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # below FIELD the difference wraps round and is the larger one


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo FIELD of numbers below it, by halves of 31 bits."""
    half = _U(2**31 - 1)
    ah, al, bh, bl = a >> _U(31), a & half, b >> _U(31), b & half
    middle = ah * bl + al * bh
    return reduced(_U(2) * ah * bh + (middle >> _U(30)) + ((middle & _U(2**30 - 1)) << _U(31)) + al * bl)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo FIELD for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = np.empty(size, np.uint64)
        out[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = multiply(out[:step], np.full(1, pow(base, done, FIELD), np.uint64))
            done += step
        _powers[base] = have = out
    return have[:n]


class Ranges:
    """Hashes of any ranges of a sequence of hashes or bytes: a polynomial in the field, mixed at the end.

    Arrays are gone through in blocks, so that what is computed on the way stays in the processor's cache.
    """

    def __init__(self, values: np.ndarray):
        n, base = len(values), powers(_MULTIPLIER, len(values))
        self.prefix = np.zeros(n + 1, np.uint64)
        high, low, shift = _U(0), _U(0), np.full(1, 2**31, np.uint64)
        for at in range(0, n, BLOCK):
            part = slice(at, min(at + BLOCK, n))
            terms = multiply(reduced(values[part].astype(np.uint64)), base[part])
            highs, lows = high + np.cumsum(terms >> _U(31), dtype=np.uint64), low + np.cumsum(terms & _U(2**31 - 1), dtype=np.uint64)
            self.prefix[at + 1 : part.stop + 1] = reduced(multiply(reduced(highs), shift) + reduced(lows))
            high, low = highs[-1], lows[-1]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, inverse = np.empty(len(start), np.uint64), powers(_INVERSE, len(self.prefix))
        for at in range(0, len(start), BLOCK):
            a, z = start[at : at + BLOCK], end[at : at + BLOCK]
            own = reduced(self.prefix[z] + _P - self.prefix[a])
            out[at : at + BLOCK] = mix(multiply(own, inverse[a]) + ((z - a).astype(np.uint64) << _U(61)))
        return out


class Slice(NamedTuple):
    """Some rows of a batch: their bytes, and where each row's text begins and ends there."""

    first: int
    n: int
    buf: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """A string column (nulls count as empty) as slices of about ``size`` bytes."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Slice(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    """Words of a slice: hashes, byte spans, and the bounds of each row's words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set bytes; a run ends with its row."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def words_of(part: Slice, lower: bool = False) -> Words:
    """``lower``: A-Z count as a-z."""
    starts, ends = runs_of(~IS_SPACE[part.buf], part.offsets)
    return Words(segment_hashes(LOWER[part.buf] if lower else part.buf, starts, ends), starts, ends, np.searchsorted(starts, part.offsets))


def window_sums(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes, at most 64 (rows are not kept apart here)."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out += hashes[k : k + n] * WINDOW_VALUES[k]
    return mix(out)
