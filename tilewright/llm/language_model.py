"""Language-model scores from a weighted backoff automaton over word n-grams.

The model is counted on the whole training corpus. States are word histories of up to two words that have
successors of their own; an arc for a successor carries its discounted log-probability, and a failure arc to
the shorter history carries the backoff weight that makes the state's distribution sum to one. The root
knows every word with add-one smoothing. From the state behind the words so far, failure arcs are followed
until the next word has an arc, and weights add up.

Every n-gram seen ``LEAST`` times or more has an arc, at any corpus size. States and arcs stay in written
tables. Following failure arcs adds up: a text's score is the sum over its words of the root's weight and the
word's failure weight, over its pairs and triples with an arc of what the arc gains over its failure path,
and of the pair's own failure weight. So a text meets its n-grams in one join on their codes, summed by row. Words above
``WORD_SHARE`` and n-grams above ``ARC_SHARE`` of the tokens (at most 1 / share of each order) are broadcast
as a cache before that join and change no result; sieves of fixed size hold back most n-grams without an arc.

Words and n-grams are told by 64-bit codes. Null and empty texts are the end token alone. Rows that repeat a
doc_id are scored as rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import discard, passes, sieve, stored
from tilewright.llm.text import Block, blocks, int64, mix, numbers_of, split_binary
from tilewright.session import tasks_for

END = 0x5851F42D4C957F2D
WORD_SHARE, ARC_SHARE = 1e-6, 2e-6
LEAST = 2
SIEVE = 1 << 27
DISCOUNT = 0.6
FLUSH = 1 << 22
HEAD = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "weight": pa.float64()}


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word codes with an end token behind each text, and the place of each text's first token."""
    out = np.full(len(block.codes) + block.size, END, np.uint64)
    out[np.arange(len(block.codes)) + block.doc] = block.codes
    return out, block.first_word + np.arange(block.size + 1)


def find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places of ``asked`` in the sorted ``keys``; -1 where absent."""
    if not len(keys) or not len(asked):
        return np.full(len(asked), -1, np.int64)
    own, back = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, at, -1)[back]


def pair_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each token with the one before, and the one before; the end token stands before a text."""
    before = np.concatenate([np.full(1, END, np.uint64), codes[:-1]])
    return mix(mix(before + np.uint64(0xA0761D6478BD642F)) + codes), before


def triple_codes(codes: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all triples, and the places of their last tokens; a text's first token has none."""
    inner = np.ones(len(codes), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    return mix(mix(pairs[at - 1] + np.uint64(0xE7037ED1A0B428DB)) + codes[at]), at


@dataclass
class Automaton:
    """A model that fits in memory: sorted keys with their weights (log10). A word's place in ``states`` names it in ``pairs``."""

    tokens: int
    vocabulary: int
    words: np.ndarray
    word_counts: np.ndarray
    states: np.ndarray
    pairs: np.ndarray
    pair_weights: np.ndarray
    pair_failure: np.ndarray


@dataclass
class Tables:
    """The written model: (key, n, fail) of all words, (key, h, l, n, p, lp) of pairs, (key, n, gain) of pairs and triples."""

    tokens: int
    vocabulary: int
    words: DataFrame
    pairs: DataFrame
    gains: DataFrame


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words per task, in batches of bounded size."""
    kept, size = [], 0

    def flush() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(kept), return_counts=True)
        return pa.record_batch({"key": int64(key), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for _, _, block in blocks(batch, "text", True):
            kept.append(tokens_of(block)[0])
            size += len(kept[-1])
            if size >= FLUSH:
                yield flush()
                kept, size = [], 0
    if size:
        yield flush()


def _ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of codes begins in sorted codes, and where the last ends."""
    edges = (np.arange(1, parts).astype(object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate([np.zeros(1, np.int64), np.searchsorted(key, edges), np.full(1, len(key), np.int64)])


def _coder(keys: Callable, parts: int, names: tuple[str, ...] = ()):
    """Per task, in batches of bounded size: sorted codes by part of their range, each as often as seen, up to ``LEAST`` times.

    With ``names``, each once with what ``keys`` gives beside it and its count ``n``.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            found = [np.concatenate(x) for x in zip(*kept)]
            order = np.argsort(found[0]) if names else None
            key = np.sort(found[0]) if order is None else found[0][order]
            at = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]]))
            n = np.diff(at, append=len(key))
            out = key[at] if names else np.repeat(key[at], np.minimum(n, LEAST))
            cuts = _ranges(out, parts)
            beside = {c: split_binary(x[order[at]], cuts) for c, x in zip(names, found[1:])} | ({"n": split_binary(n, cuts)} if names else {})
            return pa.record_batch({"part": pa.array(np.arange(parts, dtype=np.int32)), "codes": split_binary(out, cuts), **beside})

        for batch in batches:
            for _, _, block in blocks(batch, "text", True):
                codes, first = tokens_of(block)
                found = keys(codes, first[:-1])
                kept.append(found if names else found[:1])
                size += len(found[0])
                if size >= FLUSH:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    return code


def _seen_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes that all batches of a part have ``LEAST`` times or more; rows come sorted by part."""
    part, kept = None, []

    def close() -> pa.RecordBatch:
        key = np.sort(np.concatenate(kept))
        return pa.record_batch({"key": int64(np.unique(key[LEAST - 1:][key[LEAST - 1:] == key[: len(key) - LEAST + 1]]))})

    for batch in batches:
        values, bounds = numbers_of(batch.column("codes"), np.uint64)
        for r, own in enumerate(batch.column("part").to_pylist()):
            if own != part and kept:
                yield close()
                kept = []
            part = own
            kept.append(values[bounds[r]: bounds[r + 1]])
    if kept:
        yield close()


def _summed(names: tuple[str, ...]):
    """(key, names, n) of the codes seen ``LEAST`` times or more over all batches of a part; rows come sorted by part."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = None, []

        def close() -> pa.RecordBatch:
            key, *beside, n = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])[: len(key)])
            n = np.add.reduceat(n, at) if len(at) else n
            at, n = at[n >= LEAST], n[n >= LEAST]
            return pa.record_batch({"key": int64(key[at]), **{c: int64(x[order[at]]) for c, x in zip(names, beside)}, "n": pa.array(n)})

        for batch in batches:
            columns = [numbers_of(batch.column(c), np.int64 if c == "n" else np.uint64) for c in ("codes", *names, "n")]
            for r, own in enumerate(batch.column("part").to_pylist()):
                if own != part and kept:
                    yield close()
                    kept = []
                part = own
                kept.append([x[cuts[r]: cuts[r + 1]] for x, cuts in columns])
        if kept:
            yield close()

    return summed


def _repeated(texts: DataFrame, keys: Callable, label: str, tokens: int) -> DataFrame:
    """(key, h, l, n) of the n-grams seen ``LEAST`` times or more.

    Most n-grams of a corpus are seen once. So a first count moves nothing but codes, in sorted runs by part of
    their range; its survivors fill a sieve, and only what passes it is counted once more with the codes of its
    parts. There are as many ranges as keep one at about a million ``tokens``.
    """
    tasks = tasks_for(texts.sparkSession, tokens, FLUSH)
    dealt = lambda rows: rows.repartition(tasks, "part").sortWithinPartitions("part")
    codes_only = dealt(texts.mapInArrow(_coder(keys, 4 * tasks), "part int, codes binary"))
    codes_only = stored(codes_only.mapInArrow(_seen_often, "key long"), "often")
    often = texts.sparkSession.sparkContext.broadcast(sieve(codes_only, "key", SIEVE))
    discard(codes_only)

    def passing(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        found = keys(codes, first)
        ok = passes(often.value, found[0])
        return tuple(x[ok] for x in found)

    rows = dealt(texts.mapInArrow(_coder(passing, 4 * tasks, ("h", "l")), "part int, codes binary, h binary, l binary, n binary"))
    rows = stored(rows.mapInArrow(_summed(("h", "l")), "key long, h long, l long, n long"), label)
    often.destroy()
    return rows


def _arcs(counts: DataFrame, below: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(key, h, l, n, p, lp) with the probability of each arc and that of its shorter history, and (h, fail) of the histories.

    ``h`` is the code of an n-gram without its last word, ``l`` that without its first; ``below`` has (key, n, p) of both.
    The written ``counts`` are used up.
    """
    rows = counts.join(below.select(F.col("key").alias("h"), F.col("n").alias("hn")), "h")
    half = stored(rows.select("key", "h", "l", "n", ((F.col("n") - DISCOUNT) / F.col("hn")).alias("p")), label)
    discard(counts)
    rows = half.join(below.select(F.col("key").alias("l"), F.col("p").alias("lp")), "l")
    rows = stored(rows.select("key", "h", "l", "n", "p", "lp"), label)
    discard(half)
    least = lambda c: F.greatest(1 - F.sum(c), F.lit(1e-12))
    return rows, stored(rows.groupBy("h").agg((F.log10(least("p")) - F.log10(least("lp"))).alias("fail")), "failure")


def learn(texts: DataFrame) -> Tables:
    """The model of the column ``text``, counted over all texts."""
    spark = texts.sparkSession
    counts = stored(texts.mapInArrow(_counter, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = float(total["n"] + total["v"] + 1)

    def pairs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        key, before = pair_codes(codes)
        return key, before, codes

    two, fail_one = _arcs(_repeated(texts, pairs, "pairs", total["n"]), counts.withColumn("p", (F.col("n") + 1) / size), "pairs")
    known = spark.sparkContext.broadcast(sieve(two, "key", SIEVE))

    def triples(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        pair, _ = pair_codes(codes)
        key, at = triple_codes(codes, pair, first)
        ok = passes(known.value, pair)
        ok = ok[at] & ok[at - 1]
        return key[ok], pair[at - 1][ok], pair[at][ok]

    three, fail_two = _arcs(_repeated(texts, triples, "triples", total["n"]), two, "triples")
    known.destroy()
    none = F.coalesce("fail", F.lit(0.0))
    over = (F.log10("p") - F.log10("lp") - F.col("fail")).alias("gain")
    own = two.join(fail_one, "h").select("key", "n", over)
    own = own.join(fail_two.withColumnRenamed("h", "key"), "key", "left").select("key", "n", (F.col("gain") + none).alias("gain"))
    gains = stored(own.unionByName(three.join(fail_two, "h").select("key", "n", over)), "gains")
    words = stored(counts.join(fail_one.withColumnRenamed("h", "key"), "key", "left").select("key", "n", none.alias("fail")), "words")
    discard(counts, fail_one, three, fail_two)
    return Tables(total["n"], total["v"], words, two, gains)


def _sorted(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    rows = rows.combine_chunks()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return [keys[order], *(rows.column(c).to_numpy()[order] for c in columns)]


def train(texts: DataFrame) -> tuple[Automaton, DataFrame]:
    """The words and pairs of ``learn`` brought to the driver, for a corpus whose model fits there; and the counts of all words."""
    model = learn(texts)
    words, n, fail = _sorted(model.words.toArrow(), "n", "fail")
    rows = model.pairs.toArrow()
    h, l = (find(words, rows.column(c).to_numpy().view(np.uint64)) for c in ("h", "l"))
    order = np.argsort(pairs := (h << 32) | l)
    return Automaton(model.tokens, model.vocabulary, words, n, words, pairs[order], np.log10(rows.column("p").to_numpy())[order], fail), model.words


def _scorer(shared, wanted, root: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, fails, grams, gains = shared.value
        for batch in batches:
            for low, high, block in blocks(batch, "text", True):
                codes, first = tokens_of(block)
                cut = first[:-1]
                pair, _ = pair_codes(codes)
                triple, at = triple_codes(codes, pair, cut)
                known = find(words, codes)
                base = np.where(known >= 0, logs[known] if len(logs) else 0.0, 0.0) - root
                weight = base + np.where(known >= 0, fails[known] if len(fails) else 0.0, 0.0)
                rare, place = [codes[known < 0]], [np.flatnonzero(known < 0)]
                for key, where in ((pair, np.arange(len(codes))), (triple, at)):
                    hot = find(grams, key)
                    weight[where] += np.where(hot >= 0, gains[hot] if len(gains) else 0.0, 0.0)
                    ask = np.flatnonzero((hot < 0) & passes(wanted.value, key))
                    rare.append(key[ask])
                    place.append(where[ask])
                rare, place = np.concatenate(rare), np.concatenate(place)
                rows, add = batch.column("row").to_numpy()[low:high], np.add.reduceat
                yield pa.record_batch({"key": int64(rare), "row": pa.array(rows[np.searchsorted(first, place, "right") - 1]),
                                       **{c: pa.nulls(len(rare), t) for c, t in HEAD.items()}})
                yield pa.record_batch({
                    "key": int64(mix(rows.view(np.uint64))), "row": pa.array(rows), "doc_id": batch.column("doc_id").slice(low, high - low),
                    "held_out": batch.column("held_out").slice(low, high - low), "n_tokens": pa.array(np.diff(first)),
                    "known": pa.array(add((known >= 0).astype(np.int64), cut)), "base": pa.array(add(base, cut)), "weight": pa.array(add(weight, cut))})

    return score


def scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; rows held out teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    model = learn(rows.where(~F.col("held_out")).select("text"))
    discard(model.pairs)  # scores need what the pairs gain, not their parts
    often, arc = F.col("n") >= WORD_SHARE * model.tokens, F.col("n") >= ARC_SHARE * model.tokens
    words, n, fails = _sorted(model.words.where(often).toArrow(), "n", "fail")
    shared = spark.sparkContext.broadcast((words, np.log10(n + 1.0), fails, *_sorted(model.gains.where(arc).toArrow(), "gain")))
    wanted = spark.sparkContext.broadcast(sieve(model.gains.where(~arc), "key", SIEVE))
    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _scorer(shared, wanted, float(np.log10(model.tokens + model.vocabulary + 1.0))),
        "key long, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, weight double")
    # what is not in the cache comes by a join on the code, words and n-grams alike; a text's own row goes along under a code that nothing is read from
    exact = model.words.where(~often).select("key", F.lit(1).alias("more"), F.log10(F.col("n") + 1).alias("gain"), "fail").unionByName(
        model.gains.where(~arc).select("key", F.lit(0).alias("more"), F.lit(0.0).alias("gain"), F.col("gain").alias("fail")))
    asked = F.col("n_tokens").isNull()
    of = lambda c: F.coalesce(F.sum(F.when(asked, F.col(c))), F.lit(0))
    found = found.join(exact.hint("merge"), "key", "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in HEAD), of("more").alias("more"), of("gain").alias("gain"), of("fail").alias("fail"))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("gain")).alias("base_score"), (F.col("weight") + F.col("gain") + F.col("fail")).alias("score"))
