"""Words and shingles of Arrow text columns as numpy arrays, in bounded pieces.

A word is a longest run of bytes other than ASCII white space (20, 09-0D hex), so every other
character, of whatever script, belongs to a word. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_PIECE = 1 << 21  # bytes of text worked on at once (a longer document is one piece)
_RUN = 1 << 20  # bytes hashed at once

_random = np.random.default_rng(20240229)
_FACTOR = int(_random.integers(1 << 62, 1 << 63)) * 2 + 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[list(SPACES)] = 0
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BARE = _FOLDED.copy()  # as _FOLDED, but ASCII punctuation counts for nothing
_BARE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0
_GAP = np.zeros(256, bool)
_GAP[list(SPACES)] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _RUN + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, min(high, rows)
        low = high


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool = True, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, in order, and the offsets of the rows among the words.

    fold: A-Z count as a-z. bare: so they and the accented Latin-1 capitals do, and ASCII punctuation behind a
    word counts for nothing.
    """
    if bare and len(data):
        capital = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE are two bytes, C3 and 80 to 9E
        capital = capital[(data[capital] >= 0x80) & (data[capital] <= 0x9E) & (data[capital] != 0x97)]
        data = data.copy()
        data[capital] += 0x20
    gap = _GAP[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begins[firsts] = ~gap[firsts]
    starts = np.flatnonzero(begins)
    table = _BARE if bare else _FOLDED if fold else _VALUE
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        first = starts[low]
        high = max(low + 1, int(np.searchsorted(starts, first + _RUN)))
        last = starts[high] if high < len(starts) else len(data)
        values = table[data[first:last]]
        values *= _power(_FACTOR, last - first)
        own = starts[low:high] - first
        out[low:high] = np.add.reduceat(values, own) * _power(_INVERSE, int(own[-1]) + 1)[own]
        low = high
    return mixed(out), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row (of all its words, if it has fewer), and the rows' offsets.

    A row without words has none.
    """
    counts = np.diff(at)
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], n)
    h = np.zeros(len(place), np.uint64)
    limit = np.repeat(at[1:], n)
    for i in range(k):
        there = place + i
        inside = there < limit
        value = words[np.minimum(there, len(words) - 1)] if len(words) else h
        h = np.where(inside, h * np.uint64(0x9E3779B97F4A7C15) + value, h)
    return mixed(h), to


def lowered(column: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column: Column) -> Column:
    """Words of a text as a long, without Python; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id's decimal text modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
