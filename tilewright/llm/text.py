"""Words of a block of texts as numpy arrays: places, owners and 64-bit codes, without a Python loop per word.

A text is cut at ASCII white space (0x20 and 0x09-0x0D). The code of a word is a polynomial of its
bytes modulo 2**64 read off one running sum, so equal words have equal codes in every task.
Collisions are as rare as for any 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def space_table() -> np.ndarray:
    """True for the bytes that end a word."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased, all others unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS["up"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)])
        _POWERS["down"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)])
    return _POWERS["up"], _POWERS["down"]


def spans_code(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One code for each slice values[start:end], the same wherever the slice stands."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Words of consecutive texts: ``starts`` and ``ends`` in ``data``, ``doc`` the text's place in the block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, ends: np.ndarray | None = None):
        self.data, self.offsets, self.size = data, offsets, len(offsets) - 1
        inside = ~(space_table() if ends is None else ends)[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first_word)
        self.doc = np.repeat(np.arange(self.size), self.n_words)
        letters = mix(np.arange(1, 257, dtype=np.uint64))
        self.codes = spans_code((letters[lower_table()] if lower else letters)[data], self.starts, self.ends)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the runs of ``k`` words that lie inside one text, and the place of their first word."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return spans_code(self.codes, at, at + k), at


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and 64-bit offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, text: str, lower: bool, block_bytes: int = BLOCK_BYTES, ends: np.ndarray | None = None) -> Iterator[tuple[int, int, Block]]:
    """The batch's rows in runs of about ``block_bytes`` of text; a longer text is a block of its own. ``ends`` are the bytes that end a word."""
    if not batch.num_rows:
        return
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + block_bytes, "right")) - 1)
        high = min(high, low + BLOCK_DOCS)
        yield low, high, Block(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low], lower, ends)
        low = high


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices data[start:end] as strings."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def int64(values: np.ndarray) -> pa.Array:
    """Unsigned codes as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def split_binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i+1]] as the bytes of row i; ``bounds`` begins at 0."""
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def numbers_of(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``split_binary`` for a column without nulls: all values and the bounds of the rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), (offsets - offsets[0]) // size
