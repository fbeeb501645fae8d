"""64-bit hashes of all words of a batch of texts, computed on whole byte arrays at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time (a longer text is taken whole).
SLICE_BYTES = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, another one for each seed."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(32)
    return h


def _letters(delimiter, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to words, and the byte it counts as; with fold, A-Z count as a-z."""
    is_word = np.array([not delimiter(b) for b in range(256)])
    counts_as = np.arange(256, dtype=np.uint8)
    if fold:
        counts_as[65:91] = counts_as[97:123]
    return is_word, counts_as


#: Words of letters, digits and all non-ASCII characters.
ALNUM = _letters(lambda b: b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128)
#: Words between ASCII white space.
BLANK = _letters(lambda b: b == 32 or 9 <= b <= 13)
CASED = _letters(lambda b: b == 32 or 9 <= b <= 13, fold=False)
#: Longer words are hashed one by one.
LONG_BYTES = 256
_KEPT = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """For each seed a 64-bit hash of each run of bytes: eight bytes at a time are added to a state that is scrambled in between.

    data has eight bytes more than the runs. No sum over positions is taken, so no arrangement of letters cancels out.
    """
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    begin = sizes.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    part = eight[starts] & _KEPT[np.minimum(sizes, 8)]
    out = [mix(begin ^ part, seed) for seed in seeds]
    rows = np.flatnonzero((sizes > 8) & (sizes <= LONG_BYTES))
    at, left = starts[rows] + 8, sizes[rows] - 8
    while len(rows):
        part = eight[at] & _KEPT[np.minimum(left, 8)]
        for h, seed in zip(out, seeds):
            h[rows] = mix(h[rows] ^ part, seed)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_BYTES).tolist():
        run = data[starts[i] : starts[i] + sizes[i]].tobytes()
        for h, seed in zip(out, seeds):
            h[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


@dataclass
class Words:
    """Words of the rows first .. first + len(counts) - 1 of a batch."""

    first: int
    hashes: np.ndarray  # of all words in turn
    counts: np.ndarray  # words of each row
    data: np.ndarray  # the bytes of the texts as they are compared, and eight more
    starts: np.ndarray  # where words begin in data
    ends: np.ndarray
    second: np.ndarray | None = None  # other hashes of the same words, if asked for; together they are 128 bits

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first bytes, size at most."""
        return mix(_hashed(self.data, self.starts, np.minimum(self.ends - self.starts, size), 3)[0], size)


def words(column: pa.Array, letters=ALNUM, slice_bytes: int = SLICE_BYTES, twice: bool = False) -> Iterator[Words]:
    """Slices of a column of texts with the hash of each word, or two hashes; null counts as empty.

    Hashing walks over all words eight bytes at a time, so its loop is as long as the longest word, not the text.
    """
    is_word, counts_as = letters
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] and column.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        bounds = offsets[first : last + 1] - offsets[first]
        data = raw[offsets[first] : offsets[last]]
        size = len(data)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = is_word[data]
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        edge = bounds[(bounds > 0) & (bounds < size)]
        opens[edge] |= inside[1:-1][edge]
        closes[edge - 1] |= inside[1:-1][edge - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        known = np.zeros(size + 8, np.uint8)
        known[:size] = counts_as[data]
        h, *second = _hashed(known, starts, ends - starts, *((1, 2) if twice else (1,)))
        counts = np.diff(np.searchsorted(starts, bounds))
        yield Words(first, h, counts, known, starts, ends, *second)
        first = last


def shingles(w: Words, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes, bytes of their words); with fewer words than width the whole sequence is one."""
    n = len(w.hashes)
    h, size = np.zeros(max(n - width + 1, 0), np.uint64), np.zeros(max(n - width + 1, 0), np.int64)
    long = w.ends - w.starts
    for k in range(width):
        h += mix(w.hashes[k : n - width + 1 + k], k + 1)
        size += long[k : n - width + 1 + k]
    h = mix(h, 99)
    at = 0
    for i, m in enumerate(w.counts.tolist()):
        if m >= width:
            found, where = np.unique(h[at : at + m - width + 1], return_index=True)
            yield w.first + i, found, size[at + where]
        elif m:
            short = np.zeros(1, np.uint64)
            for k in range(m):
                short += mix(w.hashes[at + k : at + k + 1], k + 1)
            yield w.first + i, mix(short, 100 + m), long[at : at + m].sum(keepdims=True)
        else:
            yield w.first + i, np.empty(0, np.uint64), np.empty(0, np.int64)
        at += m
