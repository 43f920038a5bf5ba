"""Packed token matrices: best-fit-decreasing windows of token ids, with cumulative lengths and position resets.

Texts become ids and are cut as in ``packing`` (an end id behind each, overlong ones cut at full windows
without loss). Pieces are dealt to shards by a hash of the row. A shard takes its pieces from long to short;
each goes into the open window with the least room that still holds it, found in a segment tree over the
rooms from 0 to the capacity, or opens a window of its own.

A shard holds about ``SHARD_BYTES`` of text whatever the size of the input or of a source, so its windows are
built in one task with bounded memory. The ids move once. A null or empty text is the end id alone; rows that
repeat a doc_id are packed as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.packing import CAPACITY, pieces
from tilewright.llm.text import numbers_of, split_binary

SHARD_BYTES = 1 << 22
#: Shards read by one task, where the session's own number of tasks would read more.
TASK_SHARDS = 16
ROW = "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, segments array<struct<row: long, doc_id: long, start: long>>"


class OpenWindows:
    """Open windows by the room they have left; a segment tree tells the least room that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.piles: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.piles.setdefault(room, []).append(window)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def least(self, length: int) -> int | None:
        """The smallest room of ``length`` or more that an open window has."""
        i = length + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.tree[2 * i])
        return i - self.size

    def take(self, room: int) -> int:
        window = self.piles[room].pop()
        if not self.piles[room]:
            i = room + self.size
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; pieces of one length are taken in their order."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_windows, n = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = open_windows.least(length)
        if room is None:
            room, at, n = capacity, n, n + 1
        else:
            at = open_windows.take(room)
        window[i], offset[i] = at, capacity - room
        if room > length:
            open_windows.add(room - length, at)
    return window, offset


def _builder(capacity: int, pad_id: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        order = np.lexsort((offset, window))
        table, window, offset = table.take(pa.array(order)), window[order], offset[order]
        n, length = int(window[-1]) + 1, table.column("length").to_numpy()
        ids, bounds = numbers_of(table.column("ids").combine_chunks(), "<u4")
        matrix, positions, count = np.full(n * capacity, pad_id, "<u4"), np.zeros(n * capacity, "<u4"), np.arange(capacity, dtype="<u4")
        for at, low, high in zip((window * capacity + offset).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            matrix[at: at + high - low] = ids[low:high]
            positions[at: at + high - low] = count[: high - low]
        rows = np.arange(n + 1) * capacity
        first = np.searchsorted(window, np.arange(n + 1)).astype(np.int32)
        # one 0 before the ends of each window's segments
        sums = np.insert((offset + length).astype(np.int32), first[:-1], 0)
        shard = table.column("shard")[0].as_py()
        segments = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("row", "doc_id", "start")], ["row", "doc_id", "start"])
        return pa.table({
            "sequence_id": pa.array((shard << 32) + np.arange(n)), "ids": split_binary(matrix, rows),
            "cu_seqlens": pa.ListArray.from_arrays(pa.array(first + np.arange(n + 1, dtype=np.int32)), pa.array(sums)),
            "position_ids": split_binary(positions, rows), "segments": pa.ListArray.from_arrays(pa.array(first), segments)})

    return build


def matrix(docs: DataFrame, tokenizer: str, end_id: int, pad_id: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, cu_seqlens, position_ids, segments): one row per window.

    ``ids`` and ``position_ids`` are ``capacity`` little-endian unsigned 32-bit numbers. Segment i takes the places
    from cu_seqlens[i] to cu_seqlens[i + 1], its positions count from 0, and segments[i] tells the row, the
    document and the place of its first id in it; behind the last segment there are ``pad_id`` and position 0.
    """
    bytes_ = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1)).first()[0] or 0
    shards = max(1, -(-bytes_ // SHARD_BYTES))
    cut = pieces(docs, tokenizer, end_id, capacity, with_ids=True, text=text, doc_id=doc_id)
    dealt = cut.select("row", "doc_id", "start", "length", "ids", F.pmod(F.xxhash64("row", "start"), F.lit(shards)).alias("shard"))
    tasks = -(-shards // TASK_SHARDS)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(tasks, "shard")
    return dealt.groupBy("shard").applyInArrow(_builder(capacity, pad_id), ROW)
