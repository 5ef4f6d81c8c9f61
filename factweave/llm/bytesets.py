"""Vectorised word and n-gram hashing over Arrow string columns.

Texts are looked at as UTF-8 bytes.  A word is a maximal run of word bytes;
A-Z count as a-z.  All hashes are 64 bits wide and depend on the bytes alone,
so that every task and every run gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, a-z (after lower-casing) and every byte of a non-ASCII character.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in LOWER.tolist()])
#: Everything but the six ASCII white-space bytes.
NONSPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Texts handled at once, in bytes; a longer single text is cut into blocks of it.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix((LOWER.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_powers = np.cumprod(np.full(64, _STEP, dtype=np.uint64))


def _power(n: int) -> np.ndarray:
    """The first powers, n at least; those for very long words are made anew and not kept."""
    global _powers
    if n > 1 << 16:
        return np.cumprod(np.full(n, _STEP, dtype=np.uint64))
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _STEP, dtype=np.uint64))
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``size`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = buffers(batch.column(text))
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
            yield batch.slice(row, min(end, n) - row)
            row = end


def _block_words(raw: np.ndarray, cuts: np.ndarray, is_word: np.ndarray):
    """Starts, ends and hashes of the words of ``raw``; no word crosses a cut."""
    low = LOWER[raw]
    inside = is_word[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = cuts[(cuts > 0) & (cuts < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    length = ends - starts
    used = low[inside]
    begin = np.cumsum(length) - length
    place = np.arange(len(used)) - np.repeat(begin, length)
    value = _BYTE[used] * _power(int(length.max()))[place]
    return starts, ends, mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray):
    """Words of all texts: starts, ends, hashes, and the number of the first word of each text (n + 1)."""
    if len(raw) <= 2 * BLOCK:
        starts, ends, hashes = _block_words(raw, at, is_word)
    else:
        parts, pos = [], 0
        while pos < len(raw):
            end = min(pos + BLOCK, len(raw))
            while end < len(raw) and is_word[LOWER[raw[end]]]:
                gap = np.flatnonzero(~is_word[LOWER[raw[end : end + 65536]]])
                end = end + int(gap[0]) if len(gap) else min(end + 65536, len(raw))
            s, e, h = _block_words(raw[pos:end], at - pos, is_word)
            parts.append((s + pos, e + pos, h))
            pos = end
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, hashes, np.searchsorted(starts, at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, as if all were one text; len - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[k - 1 : k - 1 + n].copy()
    for j in range(k - 2, -1, -1):
        total *= _U(0xD6E8FEB86659FD93)
        total += hashes[j : j + n]
    return mix(total + _U(k))


def owner(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
