"""Which of many texts each name holds, by hashes of the names' runs of the texts' lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

NAMES_AT_ONCE = 10_000
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
_TABLE_BITS = 21


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each text begins (null texts are empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[starts[0] : starts[-1]], starts - starts[0]


class Runs:
    """Hashes of the runs of bytes of some lengths, each made from those of half its length."""

    def __init__(self, data: np.ndarray) -> None:
        self.doubled = [_SPREAD[data]]

    def of(self, length: int) -> np.ndarray:
        """The hash of the run that begins at each place (shorter at the end: a run must end with the data)."""
        found, done = None, 0
        for bit in range(length.bit_length()):
            if bit == len(self.doubled):
                half, step = self.doubled[-1], 1 << (bit - 1)
                self.doubled.append(half[: max(0, len(half) - step)] * _power(step) + half[step:])
            if length >> bit & 1:
                part = self.doubled[bit]
                if found is None:
                    found = part
                else:
                    n = max(0, len(part) - done)
                    found = found[:n] * _power(1 << bit) + part[done : done + n]
                done += 1 << bit
        return found


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Texts:
    """Texts that are looked for (none empty), by their lengths in bytes."""

    def __init__(self, texts: pa.Array) -> None:
        data, starts = bytes_of(texts)
        sizes = np.diff(starts)
        runs, self.by_size = Runs(data), []
        for size in np.unique(sizes):
            number = np.flatnonzero(sizes == size)
            codes = runs.of(int(size))[starts[number]]
            order = np.argsort(codes, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[codes >> np.uint64(64 - _TABLE_BITS)] = True
            letters = data[starts[number[order]][:, None] + np.arange(size)]
            self.by_size.append((int(size), codes[order], number[order], letters, table))

    def found(self, names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, name) for every place of a name that holds a text."""
        data, starts = bytes_of(names)
        runs, row = Runs(data), np.repeat(np.arange(len(names)), np.diff(starts))
        room = starts[1:][row] - np.arange(len(data))
        for size, codes, number, letters, table in self.by_size:
            if size > len(data):
                break
            own = runs.of(size)
            at = np.flatnonzero(table[own >> np.uint64(64 - _TABLE_BITS)] & (room[: len(own)] >= size))
            low, high = (np.searchsorted(codes, own[at], side) for side in ("left", "right"))
            n = high - low
            which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            same = (data[at[:, None] + np.arange(size)] == letters[which]).all(axis=1)
            yield number[which[same]], row[at[same]]
