"""Flat numpy views of Arrow text batches: bytes, words, hashes.

Operators that run in Arrow batches work on the bytes of many texts at once. All helpers take a
slice of a batch that holds at most ``CHUNK_BYTES`` of text (or a single longer text), so memory
does not follow the size of a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17  # arrays of eight bytes for each byte stay in the cache
WIDE_BYTES = 1 << 19  # for operators that loop over places of texts
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


# ASCII lower case, and one random 64-bit value for each byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER_VALUE = BYTE_VALUE[LOWER]


def _class(other) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(other)] = False
    return table


# Bytes of words: letters and digits, with all of non-ASCII; or all but white space.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
ALNUM[65:91] = True  # upper case counts as its lower case
NOT_SPACE = _class([0x20, *range(0x09, 0x0E)])


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown when asked for more."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base & _MASK, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up, self.down = self._run(self.base, size), self._run(self.inverse, size)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(_BASE), Powers(_STEP)


class Runs:
    """Hashes of any run of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def get(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


class Texts(NamedTuple):
    """Texts end to end: their bytes, and the n + 1 places where they begin and end."""

    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """Words of texts: byte ranges, and for each text the number of its first word (n + 1)."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def views(column: pa.Array) -> Texts:
    """A string column as bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[offsets[0] : offsets[-1]], offsets - offsets[0])


def hand_back() -> None:
    """Give freed memory back at the end of a task: workers live on, and several share an executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Record batches cut so that each holds at most ``limit`` bytes of text, or one text."""
    for batch in batches:
        whole = views(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            low, high = whole.offsets[at], whole.offsets[to]
            yield batch.slice(at, to - at), Texts(whole.data[low:high], whole.offsets[at : to + 1] - low)
            at = to
    hand_back()


def words(texts: Texts, table: np.ndarray) -> Words:
    """Maximal runs of bytes of a class; runs end where a text ends."""
    inside = np.zeros(len(texts.data) + 2, dtype=bool)
    inside[1:-1] = table[texts.data]
    start = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edge = texts.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(texts.data))]
    start[edge] = inside[1:-1][edge]
    stop[edge - 1] = inside[1:-1][edge - 1]
    begin = np.flatnonzero(start)
    return Words(begin, np.flatnonzero(stop) + 1, np.searchsorted(begin, texts.offsets))


def word_hashes(texts: Texts, found: Words, values: np.ndarray = LOWER_VALUE) -> np.ndarray:
    """One 64-bit hash for each word; by default upper and lower ASCII letters are equal."""
    return Runs(values[texts.data], BYTE_POWERS).get(found.start, found.stop)


def inside_texts(n: int, found: Words, size: int) -> np.ndarray:
    """Which of the ``n - size + 1`` runs of ``size`` words lie within one text."""
    ok = np.ones(max(0, n - size + 1), dtype=bool)
    for k in range(1, size):
        cut = found.first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def shingles(hashes: np.ndarray, found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within texts, and where they begin."""
    at = np.flatnonzero(inside_texts(len(hashes), found, size))
    return Runs(hashes, WORD_POWERS).get(at, at + size), at


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; those of the same name go."""
    gone = {n.lower() for n in columns}
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in gone}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], names=[*kept, *columns])


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
