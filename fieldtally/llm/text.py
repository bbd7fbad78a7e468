"""Texts as arrays: words, hashes and shingles of whole Arrow batches at once.

A batch of texts is one array of UTF-8 bytes with offsets; words, their 64-bit
hashes and the hashes of word sequences come from array operations, so a Python
task spends no interpreter step on a word.  Work goes in blocks of whole texts of
about a megabyte, which bounds memory; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240229)
TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: The prime of the second polynomial: products of two values below it fit 64 bits.
PRIME = 2**31 - 1
PRIME_BASE = 1_220_703_125
PRIME_TABLE = _RANDOM.integers(1, PRIME, 256, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of whole texts."""
    data, at = texts_of(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        last = min(last, rows)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of a base modulo PRIME, by doubling."""
    table, known = np.ones(size, np.uint64), 1
    while known < size:
        more = min(known, size - known)
        table[known : known + more] = table[:more] * np.uint64(pow(base, known, PRIME)) % np.uint64(PRIME)
        known += more
    return table


class Hasher:
    """Hashes of byte ranges; made once per task, as it keeps tables of powers.

    A hash joins two polynomials: one modulo 2^64, for which equal pairs can be written down
    (two patterns of 1024 characters), and one modulo a prime, for which no such pairs are
    known.  Two given ranges of n bytes hash alike by about 2^-64, and those made to agree in
    the first by n / 2^31 at most.
    """

    def __init__(self) -> None:
        one = np.ones(1, np.uint64)
        self.powers = self.inverses = self.prime_powers = self.prime_inverses = one

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            size = max(size, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
            self.prime_powers = _powers(PRIME_BASE, size)
            self.prime_inverses = _powers(pow(PRIME_BASE, -1, PRIME), size)

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums from which :meth:`ranges` takes any range."""
        return self._running(TABLE[data], PRIME_TABLE[data])

    def sums_of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`sums`, of 64-bit values in place of bytes."""
        return self._running(values, values % np.uint64(PRIME))

    def _running(self, values: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``below``: values less than PRIME; the sum of 2^32 of them fits 64 bits."""
        self._grow(len(values) + 1)
        wrapped, prime = (np.zeros(len(values) + 1, np.uint64) for _ in range(2))
        np.cumsum(values * self.powers[: len(values)], out=wrapped[1:])
        np.cumsum(below * self.prime_powers[: len(values)] % np.uint64(PRIME), out=prime[1:])
        return wrapped, prime

    def ranges(self, sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        wrapped, prime = sums
        rest = (prime[end] - prime[start]) % np.uint64(PRIME) * self.prime_inverses[start] % np.uint64(PRIME)
        return mix((wrapped[end] - wrapped[start]) * self.inverses[start] + (end - start).astype(np.uint64) + mix(rest, 77))


def word_bounds(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: runs of bytes not ``apart``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~apart[data]
    filled = at[1:] > at[:-1]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = at[:-1][filled], at[1:][filled] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(at, starts, side="right") - 1


def shingles(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether one text holds them."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total = total * np.uint64(BASE) + words[j : j + size]
    return mix(total, n), text[:size] == text[n - 1 :]


def covered(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a range of ``length`` from a start."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.subtract.at(change, np.minimum(starts + length, size), 1)
    return np.cumsum(change[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
