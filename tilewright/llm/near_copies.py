"""Near-duplicate documents: bottom-k sketches of word shingles, inverted lists, exact Jaccard.

1. One hash function orders the shingles of a text; its sketch is the ``sketch`` smallest values. Texts
   with the same shingle set share one node, so copies are never paired.
2. Shingles seen often within a task get global counts (a table of fixed size). Every sketch keeps its
   rarest values only. A linked pair shares so many values that some of the kept ones must be common to
   both (the binomial bound of ``Rule``), so a stock line or passage forms no list unless a text has little else.
3. Inverted lists of kept values. Short lists count common values of their pairs; long lists are cut into
   blocks, and pairs of blocks are spread over the cluster, so no list meets in one task.
4. Candidates meet in cells. The sketch of the union estimates the similarity, survivors are confirmed on
   full shingle sets, and a cell returns a spanning forest of its links, never all pairs.
5. Components over the confirmed links.

Nulls and empty texts have no shingles, link with nothing, and are their own component. Rows that repeat
a doc_id stay rows of their own; a component's id is the smallest non-null doc_id in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import components, discard, passes, sieve, stored, unused
from tilewright.llm.text import Block, blocks, int64, mix, numbers_of, spans_code, split_binary

SHORT_LIST = 32
BLOCK_ROWS = 256
BUCKETS = 1 << 22
LIST_BITS = 1 << 26
LOCAL_COUNT = 3
EXTRA = 3
MISS = 1e-8


@dataclass(frozen=True)
class Rule:
    """``words`` per shingle, the least similarity ``num`` / ``den``, and values per sketch."""

    words: int = 5
    num: int = 80
    den: int = 100
    sketch: int = 256

    def least_common(self, size: int) -> int:
        """Values that two linked texts share among the ``size`` smallest of their union, but for a chance of ``MISS``."""
        t, s, tail = self.num / self.den, 0, 0.0
        if t >= 1:
            return size
        whole = math.lgamma(size + 1)
        while True:
            tail += math.exp(whole - math.lgamma(s + 1) - math.lgamma(size - s + 1) + s * math.log(t) + (size - s) * math.log(1 - t))
            if tail > MISS:
                return s
            s += 1

    def dropped(self, n: np.ndarray) -> np.ndarray:
        """How many of a sketch's most frequent values can go while one common value stays."""
        full = -(-self.num * np.minimum(n, self.sketch) // self.den) - 1
        return np.maximum(np.minimum(full, self.least_common(self.sketch) - 1), 0)


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit shingles of all texts, their bounds by text, and a signature of each set."""
    codes, at = block.grams(k)
    doc = block.doc[at]
    few = np.flatnonzero((block.n_words > 0) & (block.n_words < k))
    if len(few):
        codes = np.concatenate([codes, spans_code(block.codes, block.first_word[few], block.first_word[few + 1])])
        doc = np.concatenate([doc, few])
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (codes >> np.uint64(12)))
    key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    values = key & np.uint64((1 << 52) - 1)
    bounds = np.searchsorted(key, np.arange(block.size + 1).astype(np.uint64) << np.uint64(52))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(1)))])
    return values, bounds, mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _heads(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first ``most`` values of each row, and the row of each."""
    n = np.minimum(np.diff(bounds), most)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][row], row


def _surveyor(text: str, doc_id: str, rule: Rule):
    """Per text: its set's size and signature. Per task: buckets of sketch values that came up often."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            ids, marks = batch.column(batch.schema.get_field_index(doc_id)), batch.column("mark")
            for low, high, block in blocks(batch, text, True):
                values, bounds, sig = shingle_sets(block, rule.words)
                at, _ = _heads(bounds, rule.sketch)
                np.add.at(counts, (values[at] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                n = np.diff(bounds)
                yield pa.record_batch({
                    "doc_id": ids.slice(low, high - low), "mark": marks.slice(low, high - low), "n_shingles": pa.array(n),
                    "sig": pa.array(sig.view(np.int64), mask=n == 0), "bucket": pa.nulls(high - low, pa.int64()), "seen": pa.nulls(high - low, pa.int64())})
        often = np.flatnonzero(counts >= LOCAL_COUNT)
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield pa.record_batch({"doc_id": none, "mark": none, "n_shingles": none, "sig": none, "bucket": pa.array(often), "seen": pa.array(counts[often].astype(np.int64))})

    return survey


def _poster(text: str, rule: Rule, often):
    """The kept values of each set once per task."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        counts[often.value[0]] = often.value[1]
        done: set[int] = set()
        for batch in batches:
            for _, _, block in blocks(batch, text, True):
                values, bounds, sig = shingle_sets(block, rule.words)
                n = np.diff(bounds)
                new = np.zeros(len(sig), bool)
                for i, s in enumerate(sig.tolist()):
                    if n[i] and s not in done:
                        done.add(s)
                        new[i] = True
                at, row = _heads(bounds, rule.sketch)
                at, row = at[new[row]], row[new[row]]
                order = np.lexsort((values[at], counts[(values[at] & np.uint64(BUCKETS - 1)).astype(np.int64)], row))
                at, row = at[order], row[order]
                size = np.minimum(n, rule.sketch)
                gone = rule.dropped(n)
                stay = size - np.maximum(gone - EXTRA, 0)
                first = np.searchsorted(row, np.arange(len(n)))
                kept = np.arange(len(row)) - first[row] < stay[row]
                at, row = at[kept], row[kept]
                yield pa.record_batch({"value": int64(values[at]), "sig": int64(sig[row]), "n": pa.array(n[row])})

    return post


def _passing(wanted):
    """The posts whose value the sieve lets through."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch.column("value").to_numpy())))

    return keep


def packed_sets(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Sorted sets as bytes: how many bytes a step takes, then the steps from each value to the next, the first from zero."""
    sizes = np.diff(bounds)
    steps = np.diff(values, prepend=np.uint64(0))
    steps[bounds[:-1]] = values[bounds[:-1]]
    widest = np.maximum.reduceat(steps, bounds[:-1])
    width = 1 + sum((widest >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(1, 8))
    used = np.arange(8) < np.repeat(width, sizes)[:, None]
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[used]
    ends = np.cumsum(1 + sizes * width)
    out = np.empty(ends[-1], np.uint8)
    heads = ends - (1 + sizes * width)
    inner = np.ones(ends[-1], bool)
    inner[heads] = False
    out[heads], out[inner] = width, body
    return split_binary(out, np.concatenate([np.zeros(1, np.int64), ends]))


def unpacked_set(row: np.ndarray) -> np.ndarray:
    """The inverse of ``packed_sets`` for one set."""
    steps = np.zeros(((len(row) - 1) // int(row[0]), 8), np.uint8)
    steps[:, : row[0]] = row[1:].reshape(-1, row[0])
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _setter(text: str, rule: Rule, wanted):
    """Full sets of the wanted signatures, once per task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, block in blocks(batch, text, True):
                values, bounds, sig = shingle_sets(block, rule.words)
                mine = []
                for i in np.flatnonzero(passes(wanted.value, sig) & (np.diff(bounds) > 0)).tolist():
                    if (s := int(sig[i])) not in done:
                        done.add(s)
                        mine.append(i)
                if mine:
                    rows, sizes = np.array(mine), np.diff(bounds)
                    take = np.isin(np.repeat(np.arange(block.size), sizes), rows)
                    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[rows])])
                    yield pa.record_batch({"sig": int64(sig[rows]), "shingles": packed_sets(values[take], cuts)})

    return sets


def _pairer(rule: Rule):
    """Pairs of a short list whose sizes allow a link."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            sig, n = flat.field("sig").to_numpy(), flat.field("n").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            start = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            value = batch.column("value").to_numpy()
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                i, j = np.triu_indices(size, 1)
                a, b = (start[of][:, None] + i).ravel(), (start[of][:, None] + j).ravel()
                # pairs meet in the longest list they share, so the pairs of a group have few homes; values have 52 bits
                home = np.repeat(value[of] | ((SHORT_LIST - size) << 52), len(i))
                fits = rule.den * np.minimum(n[a], n[b]) >= rule.num * np.maximum(n[a], n[b])
                a, b, home = a[fits], b[fits], home[fits]
                need = 1 + np.minimum(EXTRA, np.maximum(rule.dropped(n[a]), rule.dropped(n[b])))
                yield pa.record_batch({
                    "a": pa.array(np.minimum(sig[a], sig[b])), "b": pa.array(np.maximum(sig[a], sig[b])), "need": pa.array(need.astype(np.int64)), "home": pa.array(home)})

    return pairs


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Common values of every two rows, from bit sets over the values that at least two rows have."""
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known, place, seen = np.unique(flat, return_inverse=True, return_counts=True)
    place, row = place[seen[place] > 1], row[seen[place] > 1]
    rank = np.cumsum(seen > 1) - 1
    width = max(1, -(-int((seen > 1).sum()) // 64))
    bits = np.zeros((len(rows), width), np.uint64)
    at = rank[place]
    np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    out = np.empty((len(rows), len(rows)), np.int64)
    for i in range(len(rows)):
        out[i] = np.bitwise_count(bits & bits[i]).sum(axis=1)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def cell_links(sigs: list[int], own: list[int], sets: list[np.ndarray], rule: Rule, across: bool, least: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of one cell; ``across`` asks for pairs of two blocks only.

    The estimate looks at the part of the union that both sketches cover: the values up to the smaller of
    their largest ones. Where both sketches are whole sets it is exact.
    """
    n = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sigs), 1)
    ok = rule.den * np.minimum(n[i], n[j]) >= rule.num * np.maximum(n[i], n[j])
    if across:
        ok &= np.array(own)[i] != np.array(own)[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    heads = [s[: rule.sketch] for s in sets]
    whole = n <= rule.sketch
    tops = np.array([h[-1] for h in heads])
    tops[whole] = np.iinfo(np.uint64).max
    common = _overlaps(heads) if len(sigs) > 8 else None
    root = list(range(len(sigs)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = top(x), top(y)
        if p == q:
            continue
        both = int(common[x, y]) if common is not None else _common(heads[x], heads[y])
        if not (whole[x] and whole[y]):
            edge = min(tops[x], tops[y])
            union = int(heads[x].searchsorted(edge, "right") + heads[y].searchsorted(edge, "right")) - both
            if both < least[union]:
                continue
            both = _common(sets[x], sets[y])
        if rule.den * both >= rule.num * int(n[x] + n[y] - both):
            root[p] = q
            links.append((sigs[x], sigs[y]))
    return links


def _linker(rule: Rule):
    least = np.array([rule.least_common(u) for u in range(2 * rule.sketch + 1)])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sigs, own, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            found = cell_links(sigs, own, sets, rule, key[1] != key[2], least) if len(sigs) > 1 else []
            if found:
                yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            values, bounds = numbers_of(batch.column("shingles"), np.uint8)
            rows = zip(*(batch.column(c).to_pylist() for c in ("home", "i", "j", "own", "sig")))
            for r, (home, i, j, block, sig) in enumerate(rows):
                if (home, i, j) != key:
                    if key is not None:
                        yield from close()
                    key, sigs, own, sets = (home, i, j), [], [], []
                sigs.append(sig)
                own.append(block)
                sets.append(unpacked_set(values[bounds[r]: bounds[r + 1]]))
        if key is not None:
            yield from close()

    return link


def _named(docs: DataFrame, rule: Rule, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, sig) for every row, ``mark`` the text's hash; and (sig, root, component_id) of all sets."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    source = source.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    survey = stored(source.mapInArrow(
        _surveyor("text", "doc_id", rule), "doc_id long, mark long, n_shingles long, sig long, bucket long, seen long"), "survey")
    rows = survey.where("bucket is null").select("doc_id", "mark", "n_shingles", "sig")
    often = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    often = spark.sparkContext.broadcast((often.column("bucket").to_numpy(), often.column("seen").to_numpy()))

    texts = source.select("text")
    posts = texts.mapInArrow(_poster("text", rule, often), "value long, sig long, n long").groupBy("value", "sig").agg(F.first("n").alias("n"))
    posts = stored(posts, "posts")
    often.destroy()
    # each list's size and a checksum of its members: lists with the same members need only one of them
    sizes = posts.groupBy("value").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.sum(F.shiftright(F.xxhash64("sig", F.lit(7)), 20)).alias("y")).where("size > 1")
    sizes = stored(sizes, "sizes")
    long_lists = sizes.where(F.col("size") > SHORT_LIST).groupBy("size", "x", "y").agg(F.min("value").alias("value")).select("value", "size")
    lists = stored(sizes.where(F.col("size") <= SHORT_LIST).select("value", "size").unionByName(long_lists), "lists")
    # most values are in one list only; the sieve keeps them from moving again
    shared = spark.sparkContext.broadcast(sieve(lists, "value", LIST_BITS))
    members = stored(posts.mapInArrow(_passing(shared), "value long, sig long, n long").join(lists, "value"), "members")
    shared.destroy()
    discard(posts, sizes, lists)

    pairs = members.where(F.col("size") <= SHORT_LIST).groupBy("value").agg(
        F.collect_list(F.struct("sig", "n")).alias("members")).mapInArrow(_pairer(rule), "a long, b long, need long, home long")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("need").alias("need"), F.min("home").alias("home")).where("common >= need")
    here = F.lit(0)
    short_cells = pairs.select("home", F.explode(F.array("a", "b")).alias("sig")).distinct().select("home", here.alias("i"), here.alias("j"), here.alias("own"), "sig")
    n_blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    long_cells = members.where(F.col("size") > SHORT_LIST).select(
        F.col("value").alias("home"), "sig", F.pmod(F.xxhash64("sig", F.lit(11)), n_blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other")).select(
        "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig")
    cells = stored(short_cells.unionByName(long_cells), "cells")
    discard(members)

    wanted = spark.sparkContext.broadcast(sieve(cells, "sig"))
    sets = texts.mapInArrow(_setter("text", rule, wanted), "sig long, shingles binary").join(cells.select("sig").distinct(), "sig", "left_semi")
    sets = sets.groupBy("sig").agg(F.first("shingles").alias("shingles"))
    met = cells.join(sets, "sig").select("home", "i", "j", "own", "sig", "shingles")
    links = met.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(_linker(rule), "a long, b long")
    roots = components(links)
    wanted.destroy()
    discard(cells)

    of = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low")).join(roots, F.col("sig") == F.col("node"), "left").select(
        "sig", "low", F.coalesce("root", "sig").alias("root"))
    lowest = of.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, stored(of.join(lowest, "root").select("sig", "root", "component_id"), "names")


def near_copies(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows, names = _named(docs, rule, text, doc_id)
    out = rows.join(names, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs``: one of each component, that of the smallest id (null last), then hash of the text, then hash of the row."""
    rows, names = _named(docs, rule, text, doc_id)
    # rows that agree in id and text are in one component, so they are judged together
    groups = stored(rows.where("sig is not null").join(names.select("sig", "root"), "sig").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    best = stored(groups.groupBy("root").agg(F.min(order).alias("best")), "best")
    judged = groups.join(best, "root").select("doc_id", "mark", "n", (order == F.col("best")).alias("first"))
    judged = stored(judged.where("not first or n > 1"), "judged")
    id_, mark, line = unused("id", docs.columns), unused("mark", docs.columns), unused("line", docs.columns)
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(mark))
    named = judged.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), "first")
    equal = docs.join(named.where("first").drop("first"), same).groupBy(id_, mark).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(line)).select(f"{line}.*")
    return docs.join(named.drop("first"), same, "left_anti").unionByName(equal)
