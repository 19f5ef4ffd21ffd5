"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and TAB..CR, i.e. ``[^\\x20\\x09-\\x0D]+``.
Everything works on the UTF-8 buffer of a column, so no Python string is made for a word.
Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WORDS_AT_ONCE = 1 << 17
_RNG = np.random.default_rng(20240607)
#: Start and multipliers of two families of hashes.
_KEYS = [tuple(int(x) | 1 for x in _RNG.integers(0, 2**64, 4, dtype=np.uint64)) for _ in range(2)]
#: Longer words are hashed one by one.
LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_KNIT = np.uint64(0x9FB21C651E98DF25)
#: What a lane of 0 to 8 bytes keeps.
_WITHIN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what a large block took would stay with them through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(step: Callable) -> Callable:
    """A step over one group, or two of one key, that gives back what it used. Spark counts a function's arguments, so both kinds have theirs."""

    def done(out: pa.Table) -> pa.Table:
        give_back()
        return out

    if len(signature(step).parameters) == 1:
        return lambda table: done(step(table))
    return lambda left, right: done(step(left, right))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that close inputs get unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has at most ``limit`` bytes, or one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = (data != 32) & (data - np.uint8(9) > 4)  # below 9 it wraps
    head = np.empty(len(data), bool)
    head[0], head[1:] = True, ~solid[:-1]
    inner = offs[1:-1]
    head[inner[inner < len(data)]] = True
    tail = np.empty(len(data), bool)
    tail[:-1], tail[-1] = head[1:] | ~solid[1:], True
    starts, ends = np.flatnonzero(head & solid), np.flatnonzero(tail & solid) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, second: bool = False) -> np.ndarray:
    """A hash of each word's bytes; ``fold`` takes A-Z as a-z, ``second`` is another family with its own keys.

    Eight bytes at a time are mixed in by a keyed multiply and shift, which is one to one for words of up to eight bytes, so
    no pattern within words makes them collide in both families.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if fold else data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), WORDS_AT_ONCE):  # bounded memory
        out[i : i + WORDS_AT_ONCE] = _hashed(padded, lanes, starts[i : i + WORDS_AT_ONCE], ends[i : i + WORDS_AT_ONCE], int(second))
    return out


def _hashed(padded: np.ndarray, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    start, odd, first, last = map(np.uint64, _KEYS[family])
    size = ends - starts
    value = size.astype(np.uint64) * odd + start
    at, j = slice(None), 0
    while j == 0 or len(at):
        v = (value[at] ^ lanes[starts[at] + j] & _WITHIN[np.minimum(size[at] - j, 8)]) * first
        v ^= v >> np.uint64(32)
        v *= last
        v ^= v >> np.uint64(29)
        value[at] = v
        j += 8
        at = np.flatnonzero((size > j) & (size <= LONG_WORD)) if j == 8 else at[size[at] > j]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(start).to_bytes(8, "little")).digest()
        value[i] = int.from_bytes(digest, "little")
    return mix(value)


def _rolled(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run and one more word; the shift keeps it from being linear in the words."""
    value = value * _ROLL
    value ^= value >> np.uint64(32)
    value += word
    return value


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, made from runs of 1, 2, 4, ... words; not those of ``windows``."""

    def knit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        value = _rolled(left, right)  # a sum, in which runs that are sums themselves could change places
        value *= _KNIT
        value ^= value >> np.uint64(29)
        return value

    if len(words) < k:
        return np.zeros(0, np.uint64)
    done, size, power, value = 0, 1, words, None
    while True:
        if k & size:
            value = power if value is None else knit(value[: len(power) - done], power[done:])
            done += size
        if done == k:
            return value[: len(words) - k + 1]
        power, size = knit(power[:-size], power[size:]), 2 * size


def windows(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words inside a row, and the index of each run's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = words[:n]
    for j in range(1, k):
        value = _rolled(value, words[j : n + j])
    ends = np.repeat(rows[1:], np.diff(rows))[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends)
    return mix(value[at]), at


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int, fold: bool = False) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingles; the whole sequence if a row has 1 to k - 1 words."""
    starts, ends, rows = word_spans(data, offs)
    words = word_hashes(data, starts, ends, fold)
    value, at = windows(words, rows, k)
    cut = np.searchsorted(at, rows)
    out = []
    for i in range(len(offs) - 1):
        n = rows[i + 1] - rows[i]
        if n >= k:
            got = np.sort(value[cut[i] : cut[i + 1]])
            out.append(got[np.r_[True, got[1:] != got[:-1]]])
        elif n:
            short = np.array([n], np.uint64)
            for w in words[rows[i] : rows[i + 1]]:
                short = _rolled(short, w)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
