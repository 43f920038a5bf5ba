"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features of a text are the words and word pairs it has (case and punctuation kept), and whether a word
follows itself once or twice, each counted once and hashed into ``dims`` places. They are scaled by the
classes' log-count ratios; a linear hinge-loss model is fitted to them by dual coordinate descent.

The fit takes at most ``sample`` labelled texts, the first by the hash of their doc_id (a documented
bound: one task holds them). Scoring reads every whole text, with a model of two arrays of ``dims`` numbers.

Null and empty texts have no features and score as the model's constant. Labels without a class, an id or
a text teach nothing; of several labels of one id the largest counts, of several texts the smallest.
Without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.llm.text import Block, blocks

DIMS = 1 << 18
SAMPLE = 16_384
SHAPES = 0x632BE59BD9B4E019


def features(block: Block, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of all texts, and their bounds by text."""
    pairs, at = block.grams(2)
    twice = at[block.codes[at] == block.codes[at + 1]]
    _, three = block.grams(3)
    thrice = three[(block.codes[three] == block.codes[three + 1]) & (block.codes[three] == block.codes[three + 2])]
    doc = np.concatenate([block.doc, block.doc[at], block.doc[twice], block.doc[thrice]]).astype(np.uint64)
    code = np.concatenate([block.codes, pairs, np.full(len(twice), SHAPES, np.uint64), np.full(len(thrice), SHAPES >> 1, np.uint64)])
    key = np.sort((doc << np.uint64(32)) | (code >> np.uint64(32)) % np.uint64(dims))
    key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(key, np.arange(block.size + 1).astype(np.uint64) << np.uint64(32))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, dims: int, cost: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights times ratios, squared ratios and the constant of the fitted model."""
    seen = np.zeros((2, dims))
    for x, label in zip(rows, y):
        seen[label, x] += 1
    p, q = seen[1] + 1, seen[0] + 1
    ratio = np.where(seen.sum(axis=0) > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    sign = np.where(y == 1, 1.0, -1.0)
    scaled = [ratio[x] for x in rows]
    scale = [1 / np.sqrt(1 + r @ r) for r in scaled]
    scaled = [(r * s).astype(np.float32) for r, s in zip(scaled, scale)]
    weights, constant, dual = np.zeros(dims), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ scaled[i] + constant * scale[i]) - 1
            step = (min(max(dual[i] - gradient, 0.0), cost) - dual[i]) * sign[i]
            if step:
                dual[i] += step * sign[i]
                weights[rows[i]] += step * scaled[i]
                constant += step * scale[i]
    return weights * ratio, ratio * ratio, constant


def _fitter(dims: int, cost: float, epochs: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, y = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            y += batch.column("label").to_pylist()
            for _, _, block in blocks(batch, "text", False):
                flat, bounds = features(block, dims)
                rows += [flat[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:])]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        weights, squares, constant = fit_hinge([rows[i] for i in order], np.array(y, np.int64)[order], dims, cost, epochs)
        yield pa.record_batch({"weights": pa.array([weights.tobytes()]), "squares": pa.array([squares.tobytes()]), "constant": pa.array([float(constant)])})

    return fit


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
        sample: int = SAMPLE, dims: int = DIMS, cost: float = 1.0, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of ``label`` (0 or 1), learned from the rows of ``labels`` given."""
    marks = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).where("text is not null")
    model = known.coalesce(1).mapInArrow(_fitter(dims, cost, epochs), "weights binary, squares binary, constant double").first()
    if model is None:
        return np.zeros(dims), np.zeros(dims), 0.0
    return np.frombuffer(model["weights"]), np.frombuffer(model["squares"]), model["constant"]


def _scorer(model, dims: int, text: str, keep: list[str], out: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, constant = model.value
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, block in blocks(batch, text, False):
                flat, bounds = features(block, dims)
                sums = np.zeros((2, len(flat) + 1))
                np.cumsum(weights[flat], out=sums[0, 1:])
                np.cumsum(squares[flat], out=sums[1, 1:])
                of = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                found.append((of[0] + constant) / np.sqrt(1 + of[1]))
            marks = pa.array(1 / (1 + np.exp(-2 * np.concatenate(found))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), marks], [*keep, out])

    return score


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out``: 0 to 1, higher where class 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = StructType([docs.schema[c] for c in keep]).add(out, "double")
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_scorer(shared, len(model[0]), text, list(keep), out), kinds)
