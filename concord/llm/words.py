"""Whole batches of texts as byte arrays: words, their hashes and the hashes of word runs, in numpy.

Hashes are 64 bits: two polynomials over bytes (or word hashes) with random values and bases, modulo two primes of 32 bits, side by
side, followed by a mixing step. (Modulo a power of two some texts would always collide.) Positions are kept in 64-bit integers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LIBC = ctypes.CDLL(None)
_RANDOM = np.random.default_rng(20240607)
#: The largest primes below 2^32, and a random base for each; values of bytes are below both.
PRIMES = (4294967291, 4294967279)
BASES = tuple(int(x) for x in _RANDOM.integers(1 << 20, PRIMES[1], 2, dtype=np.uint64))
BYTE_VALUES = _RANDOM.integers(1, PRIMES[1], 256, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole of an unsigned 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    def up(base: int, prime: int) -> np.ndarray:
        out = np.ones(size, np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += more
        return out

    return [(up(base, prime), up(pow(base, -1, prime), prime)) for base, prime in zip(BASES, PRIMES)]


def powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(up[:size], down[:size]) for up, down in _powers(max(5, -(-size >> 18)) << 18)]


class RunHash:
    """Hashes of any runs values[start:end] from cumulative sums."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.parts = []
        for prime, (up, down) in zip(PRIMES, powers(self.size + 1)):
            p = np.uint64(prime)
            own = values if values.dtype == np.uint32 else values % p
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(own * up[:-1].astype(np.uint64) % p, out=sums[1:])
            self.parts.append((p, sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        (one, other) = ((sums[end] - sums[start]) % p * down[start] % p for p, sums, down in self.parts)
        return mixed(((one << np.uint64(32)) | other) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Texts:
    """Texts of some rows as one byte array; text i is data[start[i]:end[i]]. NULL counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None else np.zeros(0, np.uint8)
        self.start = offsets[:-1] - first
        self.end = offsets[1:] - first

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row that is longer."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto
    trim()


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if release := getattr(_LIBC, "malloc_trim", None):
        release(0)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
LETTERS_DIGITS = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of texts: the longest runs of bytes of a class. Word w is data[start[w]:end[w]] and
    belongs to text row[w]; text i has the words first[i]:last[i]."""

    def __init__(self, texts: Texts, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data = LOWER[texts.data] if lower else texts.data
        inside = is_word[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[texts.start] = True
        edge[n] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, texts.start)
        self.last = np.searchsorted(self.start, texts.end)
        self.row = np.repeat(np.arange(len(texts)), self.last - self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """One hash per word. Long inputs go in blocks, so that the sums stay small."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK_BYTES, "right")))
            base = int(self.start[at])
            run = RunHash(BYTE_VALUES[self.data[base : int(self.end[upto - 1])]])
            out[at:upto] = run(self.start[at:upto] - base, self.end[at:upto] - base)
            at = upto
        return out


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start[0], start[0]+1, ..., of all runs, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, size)


def combined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows as one batch. Texts get offsets of 64 bits: with 32 Arrow makes a new batch at every 2 GB."""
    if len(batches) == 1:
        return batches[0]
    large = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    schema = pa.schema([f.with_type(large.get(f.type, f.type)) for f in batches[0].schema])
    (whole,) = pa.Table.from_batches([b.cast(schema) for b in batches]).combine_chunks().to_batches()
    return whole
