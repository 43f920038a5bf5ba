"""Substring deduplication: winnowed anchors seed repeats, which are extended both ways.

A window is ``length`` consecutive words of one text. It is removed when the same words also start in a
text with a smaller doc_id; a word goes when any removed window covers it, judged on the input.

1. Seeds. The smallest of the ``length - gram + 1`` gram codes in a window is its anchor, so equal windows
   have equal anchors, and consecutive windows mostly share one. A row is one anchor occurrence with the
   run of windows around it, as far left and right as the anchor rules.
2. Anchors of one document only are sieved out (a bit table of fixed size; what slips through does no harm).
3. Extension. Occurrences whose whole run agrees form a class: all but its smallest document lose the run.
   Where an anchor has several classes, only one representative of each is opened into windows, and a
   window is compared by its code under its anchor with one minimum. No pairs are made at any size of group.
4. Overlapping windows merge into maximal spans, joined back to the texts.

A null text is empty. A null doc_id counts as larger than all others. Rows that repeat a doc_id don't
remove each other's words. Texts shorter than ``length`` words are returned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import passes, sieve, stored
from tilewright.llm.text import Block, blocks, int64, numbers_of, spans_code, split_binary

SEGMENT = 1 << 22
SIEVE = 1 << 25
LAST = (1 << 63) - 1


def gram_of(length: int) -> int:
    """Words per seed: a quarter of the length, more where a run would pass 62 windows, the bits of a mask."""
    return max(1, length // 4, length - 61)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, x
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    n = len(x) - width + 1
    return np.minimum(low[:n], low[width - span: width - span + n])


def runs(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor code, first window (word in block), windows, all window starts."""
    gram, n = gram_of(length), len(block.codes) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty
    codes = spans_code(block.codes, np.arange(len(block.codes) - gram + 1), np.arange(gram, len(block.codes) + 1))
    width, place, mask = length - gram + 1, np.empty(n, np.int64), np.uint64(2 * SEGMENT - 1)
    for low in range(0, n, SEGMENT):
        part = codes[low: low + SEGMENT + width - 1]
        best = sliding_min((part & ~mask) | np.arange(len(part), dtype=np.uint64), width)[: SEGMENT]
        place[low: low + len(best)] = (best & mask).astype(np.int64) + low
    starts = np.flatnonzero(block.doc[:n] == block.doc[length - 1:])
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty
    place = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return codes[place[new]], starts[new], np.diff(np.append(new, len(starts))), starts


def _seeder(length: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            for low, _, block in blocks(batch, "text", False):
                anchor, first, _, _ = runs(block, length)
                yield pa.record_batch({"anchor": int64(anchor), "key": pa.array(key[low + block.doc[first]])})

    return seeds


def _runner(length: int, wanted):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            for low, _, block in blocks(batch, "text", False):
                anchor, first, n, starts = runs(block, length)
                ok = passes(wanted.value, anchor)
                anchor, first, n = anchor[ok], first[ok], n[ok]
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                codes = spans_code(block.codes, at, at + length)
                doc = block.doc[first]
                yield pa.record_batch({
                    "anchor": int64(anchor), "key": pa.array(key[low + doc]), "mark": pa.array(mark[low + doc]),
                    "start": pa.array(first - block.first_word[doc]), "n": pa.array(n),
                    "codes": split_binary(codes, np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]))})

    return occurrences


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of a class."""
    for batch in batches:
        codes, bounds = numbers_of(batch.column("codes"), np.uint64)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(n)), n)
        yield pa.record_batch({
            "anchor": batch.column("anchor").take(pa.array(row)), "class": batch.column("class").take(pa.array(row)), "first": batch.column("first").take(pa.array(row)),
            "code": int64(codes), "at": pa.array((np.arange(len(row)) - bounds[:-1][row]).astype(np.int32))})


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(key, mark, start, mask): runs of windows found in an earlier text; bit i of ``mask`` is window start + i."""
    slim = docs.select("key", "text").mapInArrow(_seeder(length), "anchor long, key long")
    shared = slim.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    wanted = docs.sparkSession.sparkContext.broadcast(sieve(shared, "anchor", SIEVE))
    found = stored(docs.select("key", "mark", "text").mapInArrow(
        _runner(length, wanted), "anchor long, key long, mark long, start long, n long, codes binary").withColumn("class", F.xxhash64("codes")), "runs")
    classes = found.groupBy("anchor", "class", "codes").agg(F.min("key").alias("first"))
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    windows = classes.join(mixed, "anchor", "left_semi").mapInArrow(_open, "anchor long, class long, first long, code long, at int")
    windows = stored(windows, "windows")
    earliest = windows.groupBy("anchor", "code").agg(F.min("first").alias("low"))
    masks = windows.join(earliest, ["anchor", "code"]).where("low < first").groupBy("anchor", "class").agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("part"))
    # written, so that the join below deals out nothing but its two inputs and a frequent class can be split
    rulings = stored(classes.select("anchor", "class", "first").join(masks, ["anchor", "class"], "left"), "rulings")
    whole = F.expr("shiftleft(1L, cast(n as int)) - 1")
    return found.select("anchor", "class", "key", "mark", "start", "n").join(rulings, ["anchor", "class"]).select(
        "key", "mark", "start", F.when(F.col("key") > F.col("first"), whole).otherwise(F.coalesce("part", F.lit(0))).alias("mask")).where("mask != 0")


def _remover(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = batch.column("doc_id"), batch.column("cuts")
            for low, high, block in blocks(batch, "text", False):
                part = cuts.slice(low, high - low)
                flat = part.flatten()
                per = np.nan_to_num(np.asarray(part.value_lengths().fill_null(0))).astype(np.int64)
                begin = np.repeat(block.first_word[:-1], per) + flat.field("start").to_numpy()
                row, bit = np.nonzero((flat.field("mask").to_numpy().view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                at = begin[row] + bit
                steps = np.zeros(len(block.codes) + 1, np.int64)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + length, -1)
                gone = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                # a span ends at its text's end even where the next text begins with another
                inner = block.first_word[1:-1]
                inner = inner[(inner > 0) & (inner < len(gone))]
                split = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
                span_start = np.sort(np.concatenate([edges[::2], np.unique(split)]))
                span_end = np.sort(np.concatenate([edges[1::2], np.unique(split)]))
                owner = block.doc[span_start] if len(span_start) else np.zeros(0, np.int64)
                kept = np.flatnonzero(~gone)
                size = block.ends[kept] - block.starts[kept] + 1
                ends = np.cumsum(size)
                out = block.data[np.minimum(np.repeat(block.starts[kept] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), max(len(block.data) - 1, 0))] if len(kept) else np.zeros(0, np.uint8)
                out = out.copy()
                out[ends - 1] = 32
                word = np.searchsorted(kept, block.first_word)
                reach = np.concatenate([np.zeros(1, np.int64), ends])[word]
                # the space after a text's last word goes
                drop = np.unique(reach[1:][np.diff(reach) > 0]) - 1
                out = np.delete(out, drop)
                bounds = reach - np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(reach) > 0)])
                spans = np.searchsorted(owner, np.arange(high - low + 1))
                yield pa.record_batch({
                    "doc_id": ids.slice(low, high - low), "n_words": pa.array(block.n_words),
                    "n_removed": pa.array(np.add.reduceat(np.append(gone, False).astype(np.int64), block.first_word[:-1]) * (block.n_words > 0)),
                    "kept_text": split_binary(out, bounds).cast(pa.string()),
                    "spans": pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.StructArray.from_arrays(
                        [pa.array(span_start - block.first_word[owner]), pa.array(span_end - block.first_word[owner])], ["start", "end"]))})

    return remove


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans): kept words joined by one space, and the removed word spans."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    cuts = repeated_runs(rows, length).groupBy("key", "mark").agg(F.collect_list(F.struct("start", "mask")).alias("cuts"))
    return rows.join(cuts, ["key", "mark"], "left").select("doc_id", "text", "cuts").mapInArrow(
        _remover(length), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>")
