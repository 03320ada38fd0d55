"""Vectorised text kernels over Arrow string buffers.

Every kernel works on a *slice* of a batch (a few MB of UTF-8), so memory is bounded by the slice
budget plus the largest single text (about ten bytes a byte of it). Nulls count as empty texts.

Hashes are 64-bit and the same in every process. A byte range is hashed eight bytes at a time, each step mixed before the next
(words of up to eight bytes and one length never collide); ranges beyond LONG bytes by blake2b. Runs of words are hashed by doubling,
mixed at every level, so that no algebra of one level (repeats, swaps, Thue-Morse patterns) survives to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Byte ranges longer than this are hashed by blake2b.
LONG = 256
_SEED, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: [\x20\x09-\x0D] part words; everything else is in a word.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and non-ASCII bytes are in a word (texts are lower-cased before).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    size = end - start
    out = mix(size.astype(np.uint64) * _SEED + _LEFT)
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.flatnonzero((size > 0) & (size <= LONG))
    left, place = size[at], start[at]
    while len(at):
        part = eight[place] & _MASK[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ part) * _RIGHT + _SEED)
        more = left > 8
        at, left, place = at[more], left[more] - 8, place[more] + 8
    raw = memoryview(padded)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    _, offsets = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a flat() array."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


class Words:
    """Words of a slice of texts.

    data: the slice's bytes, lower-cased (A-Z) if asked; offsets: of its texts; start, end: byte range
    of each word; first: index of each text's first word (n + 1 entries); hash: 64 bits a word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, within: np.ndarray = SPACE, hashed: bool = True):
        data, offsets = buffers(column)
        data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = within[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = ranges(self.data, self.start, self.end)

    def text(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text number and hash of every window of n words inside one text."""
        return windows(self.hash, self.first, n)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Sums of a per-byte mask over each text."""
        return tiled(mask, self.offsets[:-1], self.offsets[1:])


def tiled(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of a mask over ranges that follow one another, with nothing but zeros between them."""
    out = np.zeros(len(lo), np.int64)
    some = hi > lo
    if some.any():
        out[some] = np.add.reduceat(mask, lo[some], dtype=np.int64)
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n values in a row."""
    level, size, out, done = hashes, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out = mix(level[: len(hashes) - n + 1] + np.uint64(n * int(_SEED) % 2**64))
            else:
                out = mix(out * _LEFT + level[done : done + len(out)])
            done += size
        if done == n:
            return out
        level = mix(level[:-size] * _RIGHT + level[size:])
        size *= 2


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First value, text number and hash of every window of n values inside one text."""
    count = np.diff(first)
    whole = np.maximum(count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), whole)
    if not len(text):
        return text, text, np.zeros(0, np.uint64)
    begun = np.cumsum(whole) - whole
    at = np.arange(len(text)) - begun[text] + first[:-1][text]
    return at, text, runs(hashes, n)[at]


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that are there twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the `size` words that windows of n words at `starts` cover."""
    steps = np.bincount(starts, minlength=size + n + 1) - np.bincount(starts + n, minlength=size + n + 1)
    return np.cumsum(steps)[:size] > 0


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of per-word values over each text."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
