"""Vectorised word splitting and hashing over Arrow string columns.

Works on the UTF-8 bytes of many texts at once, so that the Python side of a task does a few numpy
calls a batch and no work per word. A word's hash takes its length and eight of its bytes at a time, each mixed
in before the next, so no two words of eight bytes or fewer share one; words of over LONG bytes have an XXH3.
Windows of words have polynomials of these hashes. All agree between tasks and runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are handled at once; numpy needs about 40 bytes of memory for each.
SLICE_BYTES = 1 << 20


#: Bytes of a word from which on it is hashed by itself.
LONG = 64
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0..n-1 modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_class(members: bytes, but: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return ~table if but else table


#: Bytes of words: all but white space; or digits, ASCII letters and everything beyond ASCII.
PLAIN_WORD = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", but=True)
ALNUM_WORD = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null rows are empty.
    A single longer text makes a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a run of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = PLAIN_WORD, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = member[data]
        fresh = np.zeros(len(data) + 1, bool)  # a text begins here: words never cross it
        fresh[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, U64)
        size = self.ends - self.starts
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        eight = np.lib.stride_tricks.as_strided(padded, (len(self.data), 8), (1, 1))
        out = mix(size.astype(U64) * U64(_BASE))
        own, most = np.arange(len(size)), int(min(size.max(), LONG))
        for at in range(0, most, 8):
            own = own[size[own] > at] if at else own
            part = np.ascontiguousarray(eight[self.starts[own] + at]).view("<u8").reshape(-1)
            unused = (8 - np.minimum(size[own] - at, 8)).astype(U64) * U64(8)
            out[own] = mix(out[own] ^ (part << unused >> unused))
        if size.max() > LONG:
            from xxhash import xxh3_64_intdigest

            for i in np.flatnonzero(size > LONG).tolist():
                out[i] = xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), _BASE)
        return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp values of every ``width`` consecutive words of one text, and where each starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rolled = np.zeros(n, U64)
    for k, p in enumerate(powers(width)[::-1]):
        rolled += hashes[k : n + k] * p
    ends = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= ends)
    return mix(rolled[at]), at


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every ``width`` consecutive words, first of each text and the end); a text with fewer words
    has one shingle, all of them, and a text without words none."""
    counts = words.counts
    first = np.r_[0, np.cumsum(np.where(counts >= width, counts - width + 1, counts > 0))]
    hashes, out = words.hashes(), np.zeros(int(first[-1]), U64)
    rolled, at = windows(hashes, words.first, width)
    text = np.searchsorted(words.first, at, "right") - 1
    out[first[text] + at - words.first[text]] = rolled
    for k in range(1, width):
        few = np.flatnonzero(counts == k)
        out[first[few]] = mix(sum((hashes[words.first[few] + j] * p for j, p in enumerate(powers(k)[::-1])), np.full(len(few), k, U64)))
    return out, first


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times, for each pair."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of any lengths, byte by byte (high bytes of sorted values repeat)."""
    parts = []
    for c in columns:
        raw = np.ascontiguousarray(c)
        parts.append(struct.pack("<cI", raw.dtype.char.encode(), len(raw)) + raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<cI", raw, at)
        dtype = np.dtype(kind.decode())
        at += 5
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit hashes dealt by range; empty buckets are left out."""
    cuts = np.searchsorted(sorted_hashes, np.array([(i << 64) // buckets for i in range(1, buckets)], U64))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(sorted_hashes)])) if b > a]
