"""Vectorised byte, word and shingle work on Arrow columns of text."""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space between words: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

_U = np.uint64
_POWERS = 1 << 12


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def one_thread() -> None:
    """Matrix products of this process from now on in one thread each, where
    numpy's own library is the usual one: a task has one core, and threads that
    wait for small products use more of it than the products."""
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        if limit := getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None):
            limit(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


BYTE_VALUE = numbers(256, 11)
_PLACE = numbers(_POWERS, 23) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (n + 1 offsets). Null: empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte places of each word, and the number of words
    before each text (n + 1 entries)."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: the mixed sum of byte value times
    a multiplier of the byte's place in the word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    chars = BYTE_VALUE[LOWER[data[place + np.repeat(starts, sizes)]]]
    with np.errstate(over="ignore"):
        if int(sizes.max()) > _POWERS:
            chars = mix(chars + (place // _POWERS).astype(np.uint64))
        chars *= _PLACE[place % _POWERS]
        return mix(np.add.reduceat(chars, first) + sizes.astype(np.uint64))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct sorted hashes of one text's shingles of ``size`` words; with
    fewer words the whole sequence is one shingle; without words, none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    short = n < size
    size = min(n, size)
    turn = numbers(size, 37) | _U(1)
    with np.errstate(over="ignore"):
        total = hashes[: n - size + 1] * turn[0]
        for k in range(1, size):
            total += hashes[k : n - size + 1 + k] * turn[k]
        return np.unique(mix(total + _U(size if short else 0)))
