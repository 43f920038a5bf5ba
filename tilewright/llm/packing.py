"""Packing token sequences by minimum bin slack.

Texts become ids (whole texts, an end id behind each), overlong ones are cut at full windows without loss,
and the remaining pieces are packed in shards: every window takes the longest piece left and then the
multiset of remaining lengths that comes closest to its capacity. Which sums can be reached is a bit set,
one bit per sum, built length by length from long to short with multiplicities doubled; the counts of each
length are found by walking the bit sets back. Building stops when the window can be filled exactly.

Shards are dealt by a hash of the row, hold about ``SHARD`` pieces whatever the size of the input or of a
source, and end with at most a few windows that aren't full. Only lengths and checksums move.

A null or empty text is the end id alone. Rows that repeat a doc_id are packed as rows of their own.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import stored
from tilewright.llm.text import Block, blocks, mix, spans_code, split_binary

CAPACITY = 4096
SHARD = 8192
CACHE_BYTES = 24 << 20


class Known:
    """Ids by 64-bit code, in flat arrays of at most ``CACHE_BYTES``; the less recently used half goes when they are full."""

    def __init__(self):
        self.codes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size, self.used, self.ids, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), 0

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code, -1 for those not known; the others count as used now."""
        self.turn += 1
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        found = self.codes[at] == codes
        self.used[self.slot[at[found]]] = self.turn
        return np.where(found, self.slot[at], -1)

    def add(self, codes: np.ndarray, ids: list[bytes]) -> None:
        """New codes and their ids. They and those of the last look-up are never dropped."""
        order = np.argsort(codes)
        sizes, flat = np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")
        at = np.searchsorted(self.codes, codes[order])
        self.codes, self.slot = np.insert(self.codes, at, codes[order]), np.insert(self.slot, at, len(self.used) + order)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.used = np.concatenate([self.size, sizes]), np.concatenate([self.used, np.full(len(codes), self.turn)])
        self.ids = np.concatenate([self.ids, flat])
        if 40 * len(self.codes) + 4 * len(self.ids) > CACHE_BYTES:
            keep = self.used >= min(self.turn, int(np.median(self.used)) + 1)
            stay = keep[self.slot]
            self.codes, self.slot = self.codes[stay], (np.cumsum(keep) - 1)[self.slot[stay]]
            self.ids, self.size, self.used = slices(self.ids, self.start[keep], self.size[keep]), self.size[keep], self.used[keep]
            self.start = np.cumsum(self.size) - self.size

    def of(self, slots: np.ndarray) -> list[bytes | None]:
        return [self.ids[self.start[i]: self.start[i] + self.size[i]].tobytes() if i >= 0 else None for i in slots.tolist()]


def slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size], one behind the other."""
    before = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(start - before, size)]


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that a text's ids are those of its words in turn.

    Words are cut at ASCII white space. Each distinct word of a block is looked up once, by its 64-bit code; new ones are
    encoded by the tokenizer's own normalizer, splitter and merges, and so are the parts of a word that merges can't
    join, for words share them. Words with a special string go through the whole tokenizer. What is known is kept
    over the blocks and tasks of a worker within ``CACHE_BYTES``.
    """

    #: How the splitter cuts words of plain ASCII; checked against the tokenizer before use.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    PROBES = ("It's", "a1b22", "..'s", "X'LL-y", "we've,they'RE", "<b>\"q\"", "".join(map(chr, range(33, 127))), "".join(chr(c) + "a" for c in range(33, 127)))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        full = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        if full(" a\tb\n") != full("a") + full("b"):
            raise ValueError("this tokenizer keeps white space; its texts can't be encoded word by word")
        self.known, self.parts = Known(), Known()
        self.shortcut = True
        self.shortcut = all(self._words([p.encode()])[0] == np.array(full(p), "<u4").tobytes() for p in self.PROBES)

    def _cut(self, text: str) -> list[str]:
        if self.shortcut and text.isascii() and text.isprintable():
            text = text.lower()
            return [text] if text.isalpha() else self.PARTS.findall(text)
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that aren't known."""
        out: list = [None] * len(words)
        cuts: dict[int, list[str]] = {}
        for i, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            if self.special.search(text):
                out[i] = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                cuts[i] = self._cut(text)
        parts = list(dict.fromkeys(p for cut in cuts.values() for p in cut))
        ids = dict(zip(parts, self._parts(parts)))
        for i, cut in cuts.items():
            out[i] = ids[cut[0]] if len(cut) == 1 else b"".join([ids[p] for p in cut])
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        codes = words_code([p.encode() for p in parts])
        out = self.parts.of(self.parts.slots(codes))
        new = [i for i, ids in enumerate(out) if ids is None]
        for i in new:
            out[i] = array("I", [t.id for t in self.model.tokenize(parts[i])]).tobytes()
        if new:
            self.parts.add(codes[new], [out[i] for i in new])
        return out

    def encoded(self, block: Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts with ``end_id`` behind each, and the bounds of the texts."""
        codes, first, word = np.unique(block.codes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.known.slots(codes) < 0)
        if len(new):
            raw = block.data.tobytes()
            made = self._words([raw[a:b] for a, b in zip(block.starts[first[new]].tolist(), block.ends[first[new]].tolist())])
            self.known.add(codes[new], made)
        at = self.known.slots(codes)[word]
        start, size = self.known.start[at], self.known.size[at]
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(block.doc, size, block.size).astype(np.int64) + 1)])
        out = np.full(int(bounds[-1]), end_id, "<u4")
        out[np.arange(int(size.sum())) + np.repeat(block.doc, size)] = slices(self.known.ids, start, size)
        return out, bounds


def words_code(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words."""
    bounds = np.cumsum([0, *map(len, words)])
    return spans_code(mix(np.arange(1, 257, dtype=np.uint64))[np.frombuffer(b"".join(words), np.uint8)], bounds[:-1], bounds[1:])


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this worker process: tasks that follow each other share what it knows, for one tokenizer at a time."""
    kept = sys.modules.setdefault("tilewright_worker_state", types.ModuleType("tilewright_worker_state"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, WordEncoder(path)
    return kept.encoder


def _cutter(path: str, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for low, high, block in blocks(batch, "text", False):
                ids, bounds = encoder.encoded(block, end_id)
                total = np.diff(bounds)
                many = -(-total // capacity)
                text = np.repeat(np.arange(high - low), many)
                start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                edges = np.append(bounds[:-1][text] + start, bounds[-1])
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                of = pa.array(text + low)
                yield pa.record_batch({
                    "row": batch.column("row").take(of), "doc_id": batch.column("doc_id").take(of), "start": pa.array(start), "length": pa.array(np.diff(edges)),
                    "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(total[text]), "ids": split_binary(ids, edges) if with_ids else pa.nulls(len(text), pa.binary())})

    return cut


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens, ids): every text's ids cut at multiples of ``capacity``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids),
                           "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def fill(have: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts by length of the pieces for one window: the longest piece, and the rest closest to its capacity."""
    longest = max(have)
    room, reach, steps = capacity - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in have if x <= room), reverse=True):
        left, some = min(have[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(some, left)
            wider = reach | (reach << (take * length)) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left, some = left - take, some * 2
        if reach >> room & 1:
            break
    at, counts = reach.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            counts[length] = counts.get(length, 0) + take
            at -= take * length
    return counts


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece, pieces of one length taken in their order."""
    piles: dict[int, list[int]] = {}
    for i in reversed(range(len(lengths))):
        piles.setdefault(lengths[i], []).append(i)
    have, places, window = {k: len(v) for k, v in piles.items()}, [(0, 0)] * len(lengths), 0
    while have:
        at = 0
        for length, count in fill(have, capacity).items():
            for _ in range(count):
                places[piles[length].pop()] = (window, at)
                at += length
            have[length] -= count
            if not have[length]:
                del have[length]
        window += 1
    return places


def _packer(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        places = pack_lengths(table.column("length").to_pylist(), capacity)
        shard = table.column("shard")[0].as_py()
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array([(shard << 32) + w for w, _ in places], pa.int64())).append_column(
            "offset", pa.array([o for _, o in places], pa.int64()))

    return pack


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; other columns stay."""
    cut = stored(cut, "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    kinds = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(_packer(capacity), kinds)


def sequences(packed_pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths, positions): one row per window from pieces with ids; padded unless its length is a power of two."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        lengths = table.column("length").to_pylist()
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4").astype(np.int64)
        size = len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity
        return pa.table({
            "sequence_id": pa.array([table.column("sequence_id")[0].as_py()], pa.int64()),
            "ids": pa.array([np.concatenate([ids, np.full(size - len(ids), pad_id, np.int64)])], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())), "positions": pa.array([np.concatenate([np.arange(n) for n in lengths])], pa.list_(pa.int64()))})

    return packed_pieces.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInArrow(
        build, "sequence_id long, ids array<long>, lengths array<long>, positions array<long>")
