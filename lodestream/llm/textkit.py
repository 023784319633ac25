"""Vectorised text primitives over Arrow string columns.

Every function works on one *chunk*: the UTF-8 bytes of some consecutive
documents in one uint8 array, with the documents' byte offsets.  Chunks hold
about ``CHUNK_BYTES``; a longer document is a chunk of its own, so no text is
ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SUMMED = 1 << 15

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)
_powers: dict[int, np.ndarray] = {}

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_CODES = (BYTE_CODE, _rng.integers(1, 1 << 63, 256, dtype=np.uint64))

#: The words of the contracts: runs of bytes other than space and \t..\r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Runs of ASCII letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: ASCII lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = _U(base)
        np.multiply.accumulate(have, out=have)
        if size > 8 * CHUNK_BYTES:
            return have
        _powers[base] = have
    return have[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross documents.

    Returns starts, ends and, for each document, the index of its first run
    (n+1 numbers).
    """
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = np.empty(n, bool)
    begins[0], begins[1:] = member[0], member[1:] & ~member[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begins[inner] = member[inner]
    ends = np.empty(n, bool)
    ends[-1], ends[:-1] = member[-1], member[:-1] & ~member[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = member[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, half: int = 0) -> np.ndarray:
    """Sums from which ``substring_hash`` takes the hash of any substring; half 1 is a second, independent hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    powers = _power(_BASES[half], len(data))
    for a in range(0, len(data), _SUMMED):  # parts that stay in the cache
        b = min(a + _SUMMED, len(data))
        part = np.take(_CODES[half], data[a:b])
        part *= powers[a:b]
        part[:1] += out[a : a + 1]
        np.cumsum(part, out=out[a + 1 : b + 1])
    return out


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """As ``prefix_sums``, of a sequence of 64-bit hashes."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def substring_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, half: int = 0) -> np.ndarray:
    """64-bit hashes of bytes [start, end); equal bytes have equal hashes anywhere."""
    inverse = _power(_INVERSES[half], len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE):
    """(hash, start, end) of each word, and each document's first word."""
    starts, ends, first = spans(member[data], offsets)
    return substring_hash(prefix_sums(data), starts, ends), starts, ends, first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The document of each run, from the documents' first runs."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each document, sorted within it.

    Words are lower-cased over A-Z.  A document with 1 to width-1 words has one
    shingle, its whole sequence; one without words has none.  Returns all sets
    in one array and the n+1 offsets of the documents.
    """
    words, _, _, first = word_hashes(LOWER[data], offsets)
    grams = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        grams += words[k : k + len(grams)] * _U(pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64))
    grams = mix(grams)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0], keep[1:] = True, own[1:] != own[:-1]
            sets.append(own[keep])
        elif b > a:
            own = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                own = mix(own * _U(0xE7037ED1A0B428DB) + words[k])
            sets.append(own)
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=sizes[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs between consecutive offsets; empty runs give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
