"""Vectorised views of Arrow text columns: blocks of UTF-8 bytes, word spans and rolling hashes.

An Arrow string column already is one byte buffer with offsets, so words, word hashes and k-gram
hashes of thousands of documents come from a few numpy passes over that buffer. Blocks are bounded
in bytes (one longer text makes a block of its own), which bounds a Python worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
#: One random 64-bit code per byte value.
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry flag table that is set on the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words of letters and digits: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
ALNUM = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Words between ASCII white space: [^\\x20\\x09-\\x0D]+.
NOT_SPACE = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply), so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    if n <= BLOCK_BYTES < len(_powers[0]) - 1:  # one very long text must not pin its tables for ever
        _powers[0], _powers[1] = _powers[0][: BLOCK_BYTES + 1].copy(), _powers[1][: BLOCK_BYTES + 1].copy()
    return _powers[0], _powers[1]


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, data, offsets): row slices of the batch with the bytes of their texts (null: empty)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1
        end = min(len(col), max(end, at + 1))
        own = offsets[at : end + 1]
        yield batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes flagged in ``inside``, never across rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    flag = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], flag[:-1])) & ~edge[:-1]
    after = np.concatenate((flag[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the block; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _GRAM)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; the caller leaves out those across rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n].copy()
    for i in range(1, k):
        acc *= _GRAM
        acc += words[i : i + n]
    return mix(acc + np.uint64(k))


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's words begin: n_rows + 1 positions into the word arrays."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
