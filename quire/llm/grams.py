"""Words, n-gram identifiers and window minima of many texts at once, in numpy.

A batch of texts is one byte array with offsets. Identifiers are 64-bit: a polynomial over bytes or word
identifiers, read off a prefix sum modulo 2**64, then mixed. Equal entries have equal identifiers; unequal ones may too,
and some texts are built to, so identifiers only sieve: what decides is the bytes, or their digest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes of text worked on at once; the arrays beside it take up to some 100 bytes a byte.
CHUNK = 1 << 19


def _class_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: White space alone separates words.
SPACED = _class_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Any ASCII character but a lower-case letter or a digit separates words of lower-cased text.
ALNUM = _class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where x is fresh."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(maxsize=3)
def _powers_to(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.ones(1 << bits, U)
        n, step = 1, b
        while n < len(out):
            out[n : 2 * n] = out[:n] * U(step)
            n, step = 2 * n, step * step % (1 << 64)
        return out

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(base, max(20, int(n).bit_length()))


@functools.cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a column of strings or bytes; null counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, offsets = texts(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of each text's words in them. No word crosses texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, np.bool_)
    edge[offsets] = True
    before, after = np.empty(n, np.bool_), np.empty(n, np.bool_)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space between, their starts and ends in that, and the n+1 offsets of each text's words."""
    starts, ends, first = words(data, offsets, SPACED)
    keep = SPACED[data]
    solid = keep.copy()
    keep[ends[ends < len(data)]] = True  # one separator after each word, which becomes a space
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(solid, data, np.uint8(32))[keep], at[starts], at[ends - 1] + 1 if len(ends) else at[:0], first


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def spans_ids(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts] + (ends - starts).astype(U))


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_ids(prefix(byte_values()[data], BYTE_BASE), starts, ends, BYTE_BASE)


def runs_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """The identifier of each n consecutive entries; len(ids) - n + 1 of them, or none."""
    if len(ids) < n:
        return np.zeros(0, U)
    sums = prefix(ids, WORD_BASE)
    return mix((sums[n:] - sums[:-n]) * powers(WORD_BASE, len(sums))[1][: len(ids) - n + 1] + U(n))


def byte_runs_ids(data: np.ndarray, n: int) -> np.ndarray:
    return runs_ids(byte_values()[data], n)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` consecutive values stands, the leftmost of equals."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    out, have = np.arange(len(values), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        a, b = out[:-step], out[step:]
        out = np.where(values[b] < values[a], b, a)
        have += step
    return out


def inside(first: np.ndarray, window: int) -> np.ndarray:
    """Which windows of consecutive entries lie in one text; first: the n+1 offsets of the texts in the entries."""
    n = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return room[: max(0, n - window + 1)] >= window


def runs_of(change: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last entries of runs of valid entries that no change parts."""
    begins, ends = valid & change, valid & np.append(change[1:], True)
    begins[1:] |= valid[1:] & ~valid[:-1]
    ends[:-1] |= valid[:-1] & ~valid[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def digest(data: bytes) -> bytes:
    """A 128-bit cryptographic digest, which stands for the bytes themselves: equal digests are taken for equal bytes."""
    return hashlib.blake2b(data, digest_size=16).digest()


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `length` places some half-open interval covers."""
    delta = np.zeros(length + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
