"""How far the sources of a language diverge in their use of terms, from exact joint tables of count levels.

1. Occurrences by (language, source, term) and documents by (language, term) come from one pass with map-side sums.
   A language keeps the terms found in enough of its documents.
2. A term's probability in a source depends on its count there alone. So the divergence of two sources is a sum over
   the joint table of their count levels: how many kept terms occur x times in one and y times in the other.
3. Kept terms are dealt to row blocks of terms about equally frequent, sources to column blocks. In a block, every
   (source, count level) is an indicator column of zeros and ones over the block's terms; the product of the columns'
   transpose with the columns holds the joint tables of all pairs of sources at once. Its entries are at most the
   block's terms, so products of 32-bit floats are exact. Each joint table is priced with whole numbers, and only a sum
   by pair of sources leaves a block.
4. The terms that a source overuses most are ranked with partial limits before the rows move.

Blocks have a bounded number of terms and of sources, so no task holds a language, a source or a term with all its
rows; a large source adds to the counts before they move. Null text, language and source are ''. A source without
terms, and a language without kept terms, take part with counts of 0. An empty table gives an empty result; rows that
repeat an id count each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.shared import stored
from tilewright.llm.text import blocks, gathered, lower_table

BLOCK = 1 << 21
UNIT = 1_000_000_000
TERMS = 2048
SOURCES = 64
#: Indicator columns per product.
COLUMNS = 1024


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)) of the named columns, exact."""
    return F.expr(f"1 + (cast({count} + 5 as decimal(20,0)) * {UNIT}) div cast({total} + 5 * {kept} as decimal(20,0))")


def letter_ends() -> np.ndarray:
    """True for the bytes that end a term: all of ASCII but its letters."""
    table = np.arange(256) < 128
    table[65:91] = table[97:123] = False
    return table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term) of each block; a block's terms are told apart by their 64-bit codes."""
    ends, lower = letter_ends(), lower_table()
    for batch in batches:
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        for low, high, block in blocks(batch, "text", True, BLOCK, ends):
            known, mine = np.unique(group[low:high], return_inverse=True)
            codes, first, term = np.unique(block.codes, return_index=True, return_inverse=True)
            n = max(1, len(codes))
            pair, times = np.unique(block.doc * n + term, return_counts=True)
            cell, at = np.unique(mine[pair // n] * n + pair % n, return_inverse=True)
            terms = pa.concat_arrays([gathered(lower[block.data], block.starts[first], block.ends[first]), pa.array([""])])
            # the last term, '', names the groups
            places = pa.array(np.concatenate([cell % n, np.full(len(known), len(codes))]).astype(np.int64))
            of = known[np.concatenate([cell // n, np.arange(len(known))]).astype(np.int64)]
            total = lambda w: pa.array(np.concatenate([np.bincount(at, w, len(cell)).astype(np.int64), np.zeros(len(known), np.int64)]))  # noqa: B023, E731
            yield pa.record_batch({
                "lang": langs.dictionary.take(pa.array(of // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                "term": terms.take(places), "n": total(times), "docs": total(None)})


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; every group has a row with the term '' and n 0."""
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    each = docs.select(named(lang, "lang"), named(source, "source"), F.col(text).alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """Kept terms, totals and blocks of one table; every part is written once."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, text: str = "text", lang: str = "lang", source: str = "source"):
        counts = stored(counted(docs, text, lang, source), "counts")
        terms = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        self.terms = stored(terms.where(F.col("docs") >= least_docs).select("lang", "term", "total"), "terms")
        self.cells = stored(counts.where("term != ''").join(self.terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "cells")
        kept = self.terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
        own = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
        groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(kept, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("own_total", "kept", "lang_total")])
        # sources in their order, so that a column block holds neighbours
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = stored(groups.withColumn("strip", F.floor(place / SOURCES).cast("int")), "groups")

    def overused(self, most: int = 50) -> DataFrame:
        """(lang, source, term, value, rank): the terms that a source uses more than its language, the largest excess first."""
        met = self.cells.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", (probability("n", "own_total", "kept") - probability("total", "lang_total", "kept")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        return met.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def blocks(self) -> DataFrame:
        """Rows of all blocks: (lang, block, left, right, source, strip, own_total, kept, term, n); rows without a term name the sources."""
        size = F.floor(F.log2("total")).cast("int")
        bands = self.terms.groupBy("lang", size.alias("size")).agg(F.ceil(F.count("*") / TERMS).cast("int").alias("deals"))
        dealt = stored(self.terms.withColumn("size", size).join(bands, ["lang", "size"]).select(
            "lang", "term", F.concat_ws(":", "size", F.pmod(F.xxhash64("term"), F.col("deals"))).alias("block")), "dealt")
        strips = self.groups.groupBy("lang").agg(F.max("strip").alias("last"))
        met = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
        ends = lambda df, *rest: df.join(strips, "lang").select("lang", "block", "source", "strip", *rest, met).select(
            "lang", "block", F.least("strip", "other").alias("left"), F.greatest("strip", "other").alias("right"), "source", "strip", *rest)
        named = self.groups.join(dealt.select("lang", "block").distinct(), "lang")
        heads = ends(named, "own_total", "kept").select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"))
        cells = self.cells.join(dealt, ["lang", "term"]).join(self.groups.select("lang", "source", "strip"), ["lang", "source"])
        none = F.lit(0).cast("bigint")
        return heads.unionByName(ends(cells, "term", "n").select("*", none.alias("own_total"), none.alias("kept")))

    def divergence(self) -> DataFrame:
        """(lang, source, other, value): every ordered pair of sources of a language."""
        parts = self.blocks().groupBy("lang", "block", "left", "right").applyInArrow(_block_values, "lang string, source string, other string, value long")
        half = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        full = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
        pairs = self.groups.select("lang", "source").join(self.groups.select("lang", F.col("source").alias("other")), "lang").where("source != other")
        return pairs.join(full, ["lang", "source", "other"], "left").select("lang", "source", "other", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def level_prices(levels: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The probability of each count level."""
    below = total + 5 * kept
    if not len(levels) or int(levels.max()) + 5 < (1 << 63) // UNIT:
        return 1 + UNIT * (levels + 5) // max(below, 1)
    return np.array([1 + UNIT * (int(x) + 5) // below for x in levels], np.int64)


class Indicators:
    """One-hot columns of consecutive sources: for each (source, level), which of the block's terms have it."""

    def __init__(self, counts: np.ndarray, totals: list[int], kept: list[int]):
        columns, prices, self.first = [], [], [0]
        for row, total, v in zip(counts, totals, kept):
            levels, code = np.unique(row, return_inverse=True)
            hot = np.zeros((len(levels), len(row)), np.float32)
            hot[code, np.arange(len(row))] = 1
            columns.append(hot)
            prices.append(level_prices(levels, total, v))
            self.first.append(self.first[-1] + len(levels))
        self.hot, self.prices = np.concatenate(columns), np.concatenate(prices)


def priced(a: Indicators, b: Indicators) -> np.ndarray:
    """The divergences of all pairs of sources of two strips over this block's terms."""
    joint = (a.hot @ b.hot.T).astype(np.int64)
    joint *= np.abs(a.prices[:, None] - b.prices[None, :])
    return np.add.reduceat(np.add.reduceat(joint, a.first[:-1], axis=0), b.first[:-1], axis=1)


def _strips(counts: np.ndarray, totals: list[int], kept: list[int]) -> Iterator[tuple[int, Indicators]]:
    """Runs of sources with at most ``COLUMNS`` indicator columns together, or one source."""
    low, width = 0, 0
    for i in range(len(counts)):
        levels = len(np.unique(counts[i]))
        if width and width + levels > COLUMNS:
            yield low, Indicators(counts[low:i], totals[low:i], kept[low:i])
            low, width = i, 0
        width += levels
    yield low, Indicators(counts[low:], totals[low:], kept[low:])


def _block_values(table: pa.Table) -> pa.Table:
    """Sums by pair of sources from one block; a pair is told once."""
    is_head = table.column("term").is_null()
    heads = table.filter(is_head).sort_by([("strip", "ascending"), ("source", "ascending")])
    cells = table.filter(table.column("term").is_valid())
    sources, strips = heads.column("source").to_pylist(), heads.column("strip").to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    terms = cells.column("term").combine_chunks().dictionary_encode()
    counts = np.zeros((len(sources), len(terms.dictionary)), np.int64)
    counts[[place[s] for s in cells.column("source").to_pylist()], terms.indices.to_numpy()] = cells.column("n").to_numpy()
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    runs = list(_strips(counts, heads.column("own_total").to_pylist(), heads.column("kept").to_pylist()))
    out: list[tuple[str, str, int]] = []
    for n, (i, a) in enumerate(runs):
        for j, b in runs[n:]:
            if left not in strips[i: i + len(a.first) - 1] or right not in strips[j: j + len(b.first) - 1]:
                continue
            values = priced(a, b)
            for x in range(values.shape[0]):
                for y in range(values.shape[1]):
                    p, q = i + x, j + y
                    if p < q and strips[p] == left and strips[q] == right:
                        out.append((sources[p], sources[q], int(values[x, y])))
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(out), pa.string()), "source": pa.array([o[0] for o in out], pa.string()),
                     "other": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})


def audit(docs: DataFrame, least_docs: int = 30, most: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from all other sources (``pair``) and the terms overused most (``term``)."""
    found = Audit(docs, least_docs, text, lang, source)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = found.divergence().withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return pairs.unionByName(found.overused(most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
