"""Vectorised words, hashes and windows over many texts at once, for Arrow functions.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum for the whole buffer, then mixed.
Hashes depend only on the constants below, so equal words get equal hashes on every executor and in every run. The sum is
taken block by block, so that a very long text needs no tables of its length, neither then nor later.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=U)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Bytes of text handled at once; a longer text is still handled whole.
CHUNK = 1 << 20

#: Bytes or words of one block of running sums; tables are kept up to this length.
BLOCK = 1 << 18
_tables: list[np.ndarray] = []


def _power(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, base, U)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, at most a block."""
    if not _tables:
        _tables[:] = [_power(_BASE, BLOCK), _power(_INVERSE, BLOCK)]
    return _tables[0][:n], _tables[1][:n]


def sums(values: np.ndarray, places: list[np.ndarray], table: np.ndarray | None = None) -> list[np.ndarray]:
    """For ascending places, the sums of values[i] * _BASE**i (of table[values[i]] if given) over i < place, and of the first
    of ``places`` also what divides out _BASE**place."""
    n = len(values)
    out = [np.empty(len(p), U) for p in places]
    inverse = np.empty(len(places[0]), U)
    carry, scale, back = U(0), 1, 1
    far, near = pow(_BASE, BLOCK, 1 << 64), pow(_INVERSE, BLOCK, 1 << 64)
    for o in range(0, max(n, 1), BLOCK):
        part = values[o : o + BLOCK]
        power, inverted = powers(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum((part if table is None else table[part]) * power, out=total[1:])
        total *= U(scale)
        total += carry
        last = o + BLOCK >= n
        for i, (p, x) in enumerate(zip(places, out)):
            a, b = np.searchsorted(p, [o, n + 1 if last else o + BLOCK])
            x[a:b] = total[p[a:b] - o]
            if not i:
                inverse[a:b] = powers(BLOCK)[1][np.minimum(p[a:b] - o, BLOCK - 1)] * U(back)
        carry = total[-1]
        scale, back = scale * far % (1 << 64), back * near % (1 << 64)
    return [*out, inverse]


def folded(values: np.ndarray) -> np.ndarray:
    """The sum of values[i] * _BASE**i, one number for all of them."""
    with np.errstate(over="ignore"):
        return sums(values, [np.array([len(values)])])[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """Wraps an Arrow function: when a task of it ends, freed memory goes back to the system. Spark keeps Python workers
    for later stages, and what their allocators hold on to adds up beside the next stage's own."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


@dataclass
class Words:
    """Words of several texts. ``first[d]:first[d + 1]`` are the words of text d; starts and ends are in ``buffer``."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of all texts; with ``lower`` A-Z hash as a-z (the buffer keeps them)."""
    buffer = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buffer, np.uint8)
    edges = []
    for o in range(0, len(a), BLOCK):  # a block and the byte before it, white space before the first
        inside = ~_SPACE[a[max(0, o - 1) : o + BLOCK]]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + max(1, o)
        edges.append(np.concatenate([[0], edge]) if not o and inside[0] else edge)
    edge = np.concatenate(edges)
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        low, high, inverse = sums(a, [starts, ends], _BYTE_LOWER if lower else _BYTE)
        hashes = mix((high - low) * inverse)
    begin = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.concatenate([[0], np.searchsorted(starts, begin)]).astype(np.int64)
    return Words(buffer, starts, ends, first, hashes)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, one at each word, and whether the run stays within its text."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(n, U), np.zeros(n, bool)
    out = np.zeros(n, U)
    m = n - size + 1
    at = np.arange(m)
    low, high, inverse = sums(w.hashes, [at, at + size])
    out[:m] = mix((high - low) * inverse + U(size))
    left = np.repeat(w.first[1:], w.counts()) - np.arange(n)
    return out, left >= size


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive rows of a batch with about ``size`` bytes of text: first row, end row, texts (null: empty)."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + size, side="right")) - 1)
        yield a, b, [t or b"" for t in texts.slice(a, b - a).to_pylist()]
        a = b
