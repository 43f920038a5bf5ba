"""Token counts from a finite-state transducer compiled from a piece tokenizer.

No piece of the vocabulary has a word mark behind another character, and none holds a line feed, so merges
never cross those places. A text is therefore read by a transducer whose states are the unfinished
segments (runs up to the next such place): characters lead deeper into a trie of segments, and the
transition that leaves a segment emits the number of tokens it has. Paths of the trie are stored as single
edges with their count, compiled on first use.

A chunk of text is a map over states that is the same for all of them but for its ends: what precedes its
first boundary, the tokens emitted between, and what follows the last. Such maps compose associatively, so
chunks of a long text are read in different tasks and put together by a scan in their order.

A null text is empty and has no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.text import texts_of

MARK = "▁"
CHUNK_CHARS = 1 << 16
EDGES = 500_000
SEGMENT = re.compile(rb" +[^ \n]*|\n[^ \n]*|^[^ \n]+")


@dataclass(frozen=True)
class StateMap:
    """``head`` up to the first boundary, ``tokens`` emitted behind it, ``tail`` from the last boundary on; no tail: no boundary."""

    head: bytes
    tokens: int
    tail: bytes | None


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) or "\n" in name for name in names) or [names[i] for i in self.model.encode("a  \na")] != [MARK + "a", MARK * 2, "<0x0A>", "a"]:
            raise ValueError("segments of this vocabulary can't be read apart")
        self.emits: dict[bytes, int] = {}

    def _compile(self, segments: set[bytes]) -> None:
        """Edges for ``segments``; one without a mark or line feed in front stands for itself behind a mark."""
        if len(self.emits) > EDGES:
            self.emits.clear()
        new = [s for s in segments if s not in self.emits]
        # the model puts one mark before every text: it stands for a segment's first, and is taken off behind a line feed
        bare = [(s[1:] if s[:1] == b" " else s).decode("utf-8", "replace") for s in new]
        for segment, ids in zip(new, self.model.encode(bare, num_threads=1) if new else ()):
            self.emits[segment] = len(ids) - 1 if segment[:1] == b"\n" else len(ids) or 1

    def count(self, segments: list[bytes]) -> int:
        self._compile(set(segments))
        return sum(map(self.emits.__getitem__, segments))

    def read(self, text: bytes) -> int:
        """The tokens of a whole text."""
        if not text:
            return 0
        marked = b" " + text.replace(MARK.encode(), b" ")
        plain = marked.replace(b"\n", b" \n")
        if b"  " in plain or plain[-1:] == b" ":
            return self.count(SEGMENT.findall(marked))
        # no run of marks: every cut is a boundary, and the mark before each part goes without saying
        return self.count(plain.split(b" ")[1:])

    def chunk(self, text: bytes, first: bool) -> StateMap:
        """The map of one chunk; the first one of a text has the mark that the model puts before it."""
        marked = text.replace(MARK.encode(), b" ")
        if first and marked:
            marked = b" " + marked
        # a boundary is a line feed, or a mark behind another character; a mark at the chunk's start may continue a run
        at = [m.start() for m in re.finditer(rb"\n|(?<=[^ ]) ", marked)]
        if not at:
            return StateMap(marked, 0, None)
        inner = [marked[a:b] for a, b in zip(at, at[1:])]
        return StateMap(marked[: at[0]], self.count(inner), marked[at[-1]:])

    def compose(self, left: StateMap, right: StateMap) -> StateMap:
        # a mark that opens the right chunk is a boundary after all if the left one ends with another character
        if right.head[:1] == b" " and (left.head if left.tail is None else left.tail)[-1:] not in (b" ", b""):
            right = StateMap(b"", 0, right.head) if right.tail is None else StateMap(b"", self.count([right.head]) + right.tokens, right.tail)
        if left.tail is None:
            return StateMap(left.head + right.head, right.tokens, right.tail)
        if right.tail is None:
            return StateMap(left.head, left.tokens, left.tail + right.head)
        return StateMap(left.head, left.tokens + self.count([left.tail + right.head]) + right.tokens, right.tail)

    def finish(self, whole: StateMap) -> int:
        return whole.tokens + self.count([s for s in (whole.head, whole.tail) if s])


def _reader(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "n_tokens": pa.array([machine.read(r) for r in raw], pa.int64())})

    return read


def _chunker(path: str):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in batches:
            found = [machine.chunk(t.encode(), first == 0) for t, first in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "part", "doc_id", "n_bytes")), pa.array([m.head for m in found], pa.binary()), pa.array(
                [m.tokens for m in found], pa.int64()), pa.array([m.tail for m in found], pa.binary())], ["row", "part", "doc_id", "n_bytes", "head", "tokens", "tail"])

    return maps


def _scanner(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, whole = Transducer(path), None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch({"doc_id": pa.array([key[1]], pa.int64()), "n_bytes": pa.array([key[2]], pa.int64()), "n_tokens": pa.array([machine.finish(whole)], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                mine = StateMap(r["head"], r["tokens"], r["tail"])
                if key is not None and key[0] == r["row"]:
                    whole = machine.compose(whole, mine)
                else:
                    if key is not None:
                        yield row()
                    key, whole = (r["row"], r["doc_id"], r["n_bytes"]), mine
        if key is not None:
            yield row()

    return scan


def token_counts(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; texts of more than ``chunk_chars`` characters are read in chunks."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(_reader(model), "doc_id long, n_bytes long, n_tokens long")
    long_rows = rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    parts = long_rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int")))).select(
        "row", "part", "doc_id", "n_bytes", F.expr(f"substring(text, part * {chunk_chars} + 1, {chunk_chars})").alias("text"))
    maps = parts.repartition("row", "part").mapInArrow(_chunker(model), "row long, part int, doc_id long, n_bytes long, head binary, tokens long, tail binary")
    scanned = maps.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_scanner(model), "doc_id long, n_bytes long, n_tokens long")
    return short.unionByName(scanned)
