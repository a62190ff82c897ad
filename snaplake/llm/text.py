"""Byte-level views of text columns, for vectorised work inside Arrow tasks.

A task reads Arrow batches and cuts each into blocks of about a megabyte of whole texts, so what
it holds follows the block and the longest text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Texts(NamedTuple):
    """Rows ``first .. first + len(starts)`` of a batch: text i is ``data[starts[i]:ends[i]]``."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, pad: int = 0, filler: int = 0x20, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Blocks of whole texts; null is the empty text. ``pad`` filler bytes precede and follow every text."""
    data, offsets = _bytes_of(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        starts = offsets[at:to] - offsets[at]
        ends = offsets[at + 1 : to + 1] - offsets[at]
        if pad:
            shift = pad * np.arange(1, to - at + 1)
            spaced = np.full(len(part) + pad * (to - at + 1), filler, np.uint8)
            spaced[np.arange(len(part)) + np.repeat(shift, ends - starts)] = part
            part, starts, ends = spaced, starts + shift, ends + shift
        yield Texts(at, part, starts, ends)
        at = to


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Rolling:
    """64-bit hashes of many spans of one array from two lookups each, as sums of powers modulo 2^64."""

    def __init__(self, base: int, seed: int):
        self._base, self._inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if n > len(self._up):
            n = 1 << (n - 1).bit_length()  # short texts need short tables, also on the driver
            self._up, self._down = (
                np.cumprod(np.concatenate((np.ones(1, U64), np.full(n - 1, b, U64)))) for b in (self._base, self._inverse)
            )

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes, or of 64-bit hashes as they are."""
        self._powers(len(values) + 1)
        values = self.letters[values] if values.dtype == np.uint8 else values
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self._up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._down[starts])


BYTES = Rolling(0x9E3779B97F4A7C15, seed=11)
ITEMS = Rolling(0xD1342543DE82EF95, seed=12)


#: Sums of powers modulo 2^64 are equal for some unlike strings of regular make, from some 500 bytes on.
LONG = 128


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes as they are, by a hash of another kind for long ones."""
    found = BYTES.spans(BYTES.sums(data), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG):
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return found


def blank(data: np.ndarray) -> np.ndarray:
    """Where ASCII white space stands (space, tab to carriage return)."""
    return _BLANK[data]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: the row of every entry, and its place in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each position belongs to, for ascending starts of rows."""
    return np.searchsorted(starts, positions, side="right") - 1


class Known:
    """Values by 64-bit hash, as sorted arrays that grow; forgets all beyond ``limit`` (a cache, not a result)."""

    def __init__(self, limit: int = 1 << 21):
        self._limit = limit
        self.keys, self.slots, self.size = np.zeros(0, U64), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slots[at], self.keys[at] == keys

    def full(self, more: int) -> bool:
        return self.size + more > self._limit and self.size > 0

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give new ascending keys the next slots."""
        slots = np.arange(self.size, self.size + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.size += len(keys)
        return slots

    def clear(self) -> None:
        self.__init__(self._limit)

