"""Vectorised text helpers for use inside Arrow tasks: words, rolling hashes, shingles.

Texts are handled in chunks of whole documents of about CHUNK_BYTES, so memory
is bounded by the larger of that and one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: classes of bytes: words by white space; letters and digits alone; those and, apart, other signs
BY_SPACE = (~IS_SPACE).astype(np.uint8)
ALNUM = np.zeros(256, np.uint8)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
ALNUM_OR_SIGN = np.where(ALNUM == 1, 1, 2).astype(np.uint8) * BY_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_2 = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:      # a very long text's table is not kept
            _powers[name] = have
    return have


class Spans:
    """Hashes of any byte spans of a buffer, from one running sum."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        n = len(buf)
        self.inverse = _power("inverse", BASE_INVERSE, n + 1)
        terms = (_BYTE_2 if second else _BYTE)[buf]
        terms *= _power("base", BASE, n + 1)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def binary_parts(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        empty = b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""
        col = col.fill_null(empty)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets * 0
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if len(col) else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray,
               classes: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of one class (class 0: none), and each document's first run."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind = classes[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[[0, -1]] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    word = kind > 0
    starts = np.flatnonzero(word & edge[:-1])
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray = BY_SPACE,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, with A-Z lower-cased, and each document's first word index."""
    starts, ends, bounds = word_spans(buf, offsets, classes)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    return Spans(LOWER[buf] if lower else buf).hash(starts, ends), bounds


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document with fewer than ``size`` words has its whole sequence as one
    shingle; without words its set is empty.
    """
    words, bounds = word_hashes(buf, offsets)
    if len(words):
        rolled = words.copy()
        for j in range(1, min(size, len(words))):
            rolled[:-j] = mix(rolled[:-j] * BASE + words[j:])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            h = words[a:a + 1].copy()
            for j in range(a + 1, b):
                h = mix(h * BASE + words[j:j + 1])
            yield mix(h + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_key(values: np.ndarray) -> int:
    """64 bits that stand for a set of hashes."""
    tail = np.array([values.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(values + BASE)), len(values)],
                    dtype=np.uint64)
    return int(mix(mix(mix(tail[0:1]) + tail[1:2]) + tail[2:3]).view(np.int64)[0])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers with the positions of their entries, in their order."""
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b]:ends[b + 1]]


def group_starts(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
