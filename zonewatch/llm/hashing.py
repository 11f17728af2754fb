"""Words and shingles of Arrow text columns as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.full(max(n, 1024), _BASE, dtype=np.uint64))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in `data`, and the word number at which each row starts."""
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1]
    first = first[first < len(data)]
    begins[first] = inside[first]  # a row's start ends the word before it
    starts = np.flatnonzero(begins)
    total = np.cumsum(inside)
    upto = np.append(starts[1:], len(data))
    lengths = total[upto - 1] - (total[starts] - 1) if len(starts) else np.zeros(0, np.int64)
    return starts, lengths.astype(np.int64), np.searchsorted(starts, at)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and the word number at which each row starts."""
    starts, lengths, rows = word_spans(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    heads = np.cumsum(lengths) - lengths
    pos = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    flat = lower_bytes(data[np.repeat(starts, lengths) + pos]).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(flat * _power_table(int(lengths.max()))[pos], heads)
        return mix(h + lengths.astype(np.uint64) * _ODD[0]), rows


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every k consecutive words; of all words where there are fewer; none without words."""
    n = len(h)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.sum(h * _ODD[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
        s = h[:n - k + 1] * _ODD[0]
        for i in range(1, k):
            s = s + h[i:n - k + 1 + i] * _ODD[i]
        return mix(s)


def row_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of every row."""
    raw, at = text_bytes(column)
    for i, j in chunks(at):
        h, rows = word_hashes(raw[at[i]:at[j]], at[i:j + 1] - at[i])
        for r in range(j - i):
            yield i + r, h[rows[r]:rows[r + 1]]


def row_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and the sorted distinct shingle hashes of every row."""
    for r, h in row_words(column):
        yield r, np.unique(shingle_hashes(h))


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
