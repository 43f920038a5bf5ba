"""Benchmark decontamination with a distributed positional inverted index.

``PositionalIndex`` stores a posting (text, position, term) for every token of the training texts that the
test set uses as a term; other tokens cannot take part in an intersection. Postings lie in a written table,
and each text also leaves a head posting with its id and length.

* Exact phrases: every test window starts from its two rarest terms. Their posting lists, each shifted by
  the term's offset, are intersected on (text, start); the few starts that remain are intersected with the
  shifted lists of all other terms, read only for the texts that still take part.
* Proximity: the rarest term's postings are centres, and the other terms' postings around them must
  fit, all together, into a span of the phrase's length plus a slack.

No list is gathered: intersections are equi-joins on (text, position, term), which spread a frequent term
over its texts. The vocabulary is joined by whatever way its written size lets Spark choose.

A word is a run of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. Null texts and items
have no words. Items with the same words count as one phrase with several ids; a null item_id matches and
marks words, but is no id. Rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.shared import stored

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased; the built-in lower() does the same to ASCII words, and faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def pieces(text: Column) -> Column:
    """The words in order, with an empty piece before or behind where the text doesn't begin or end with a word."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def words(text: Column) -> Column:
    return F.transform(F.array_remove(pieces(text), ""), lowered)


def phrases_of(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrase, words) of the distinct word sequences, and (phrase, item_id)."""
    each = stored(items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).where(F.size("words") > 0).withColumn(
        "phrase", F.xxhash64(F.array_join("words", " "))), "items")
    return each.groupBy("phrase").agg(F.first("words").alias("words")), each.select("phrase", "item_id").distinct()


class PositionalIndex:
    """Postings of ``docs`` for the terms in ``vocabulary`` (column ``word``)."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, text: str = "text", doc_id: str = "doc_id"):
        vocabulary = stored(vocabulary.select("word", F.xxhash64("word").alias("term")).distinct(), "vocabulary")
        cut = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), pieces(F.col(text)).alias("pieces"))
        n = F.size("pieces") - (F.col("pieces")[0] == "").cast("int") - ((F.size("pieces") > 1) & (F.element_at("pieces", -1) == "")).cast("int")
        tokens = cut.select("row", "doc_id", "mark", n.alias("n"), "pieces").select("row", "doc_id", "mark", "n", F.posexplode("pieces").alias("pos", "word"))
        tokens = tokens.withColumn("word", lowered(F.col("word"))).join(vocabulary, "word", "left").where("term is not null or pos = 0")
        head = F.col("pos") == 0
        self.table = stored(tokens.select("row", "pos", "term", *[F.when(head, F.col(c)).alias(c) for c in ("doc_id", "mark", "n")]), "postings")
        self.postings = self.table.where("term is not null").select("row", "pos", "term")

    def texts(self) -> DataFrame:
        """(row, doc_id, mark, n_words): one row for each text; ``mark`` is xxhash64 of it."""
        return self.table.where("pos = 0").select("row", "doc_id", "mark", F.col("n").cast("bigint").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return stored(self.postings.groupBy("term").agg(F.count("*").alias("seen")), "frequencies")

    def _terms(self, phrases: DataFrame) -> DataFrame:
        """(phrase, size, offset, term, seen); terms without postings have none seen."""
        each = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
        return each.join(self.frequencies(), "term", "left").select("phrase", "size", "offset", "term", F.coalesce("seen", F.lit(0)).alias("seen"))

    def exact(self, phrases: DataFrame, window: int) -> DataFrame:
        """(phrase, row, start, end): runs of at least ``window`` words of a phrase (all words of a shorter one), end exclusive."""
        terms = stored(self._terms(phrases), "terms")
        spelled = terms.groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("offset", "term", "seen"))).alias("t"))
        least = F.least("size", F.lit(window))
        starts = spelled.select("phrase", "size", "t", F.explode(F.sequence(F.lit(1), F.col("size") - least + 1)).alias("s"))
        by_rarity = F.array_sort(F.transform(F.slice("t", F.col("s"), least), lambda x: F.struct(x["seen"].alias("seen"), x["offset"].alias("offset"), x["term"].alias("term"))))
        starts = starts.select("phrase", by_rarity.alias("r")).where(F.col("r")[0]["seen"] > 0)
        second = F.try_element_at("r", F.lit(2))
        seeds = stored(starts.select("phrase", F.col("r")[0]["offset"].alias("o1"), F.col("r")[0]["term"].alias("t1"), F.coalesce(second["offset"], F.col("r")[0]["offset"]).alias("o2"),
                                     F.coalesce(second["term"], F.col("r")[0]["term"]).alias("t2")).distinct(), "seeds")
        rare = stored(self.postings.join(seeds.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "term", "left_semi"), "rare")
        first = rare.join(seeds, F.col("term") == F.col("t1")).select("phrase", "row", (F.col("pos") - F.col("o1")).alias("start"), "o2", F.col("t2").alias("term"))
        first = first.withColumn("pos", F.col("start") + F.col("o2"))
        both = stored(first.join(rare, ["row", "pos", "term"], "left_semi").select("phrase", "row", "start").distinct(), "starts")
        rest = both.join(terms, "phrase").select("phrase", "row", "start", "size", "offset", (F.col("start") + F.col("offset")).alias("pos"), "term")
        taking_part = stored(both.select("row").distinct(), "rows")
        met = rest.join(self.postings.join(taking_part, "row", "left_semi"), ["row", "pos", "term"], "left_semi")
        run = F.col("offset") - F.row_number().over(Window.partitionBy("phrase", "row", "start").orderBy("offset"))
        runs = met.withColumn("run", run).groupBy("phrase", "row", "start", "size", "run").agg(F.min("offset").alias("low"), F.count("*").alias("n"))
        return runs.where(F.col("n") >= least).select("phrase", "row", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("low") + F.col("n").cast("int")).alias("end"))

    def near(self, phrases: DataFrame, slack: int) -> DataFrame:
        """(phrase, row, start, end): the tightest spans around each rarest-term posting, of at most the phrase's length
        plus ``slack`` words, that hold all of its distinct terms in any order."""
        terms = stored(self._terms(phrases).groupBy("phrase", "size", "term", "seen").agg(F.min("offset").alias("offset")), "terms")
        whole = terms.groupBy("phrase", "size").agg(F.count("*").alias("k"), F.min(F.struct("seen", "offset", "term")).alias("rarest")).where("rarest.seen > 0")
        whole = stored(whole.select("phrase", "k", (F.col("size") + slack).alias("span"), F.col("rarest.term").alias("term")), "centres")
        centres = self.postings.join(whole, "term").select("phrase", "row", "k", "span", F.col("pos").alias("centre"))
        cell = F.floor(F.col("centre") / F.col("span"))
        asked = centres.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(terms.select("phrase", "term"), "phrase")
        cells = self.postings.join(terms.select("term", "phrase").join(whole.select("phrase", "span"), "phrase").select("term", "span").distinct(), "term")
        cells = cells.withColumn("cell", F.floor(F.col("pos") / F.col("span")))
        around = asked.join(cells, ["row", "term", "span", "cell"]).where("abs(pos - centre) < span")
        around = around.groupBy("phrase", "row", "k", "span", "centre").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("p"))

        def end(x: Column) -> Column:
            """The last of the first positions, from x on, at which all terms have come up."""
            later = F.filter("p", lambda q: (q["pos"] >= x["pos"]) & (q["pos"] < x["pos"] + F.col("span")))
            fresh = F.filter(later, lambda q: ~F.exists(later, lambda o: (o["term"] == q["term"]) & (o["pos"] < q["pos"])))
            return F.when(F.size(fresh) == F.col("k"), F.array_max(F.transform(fresh, lambda q: q["pos"])))

        spans = F.filter(F.transform("p", lambda x: F.struct((end(x) - x["pos"]).alias("length"), x["pos"].alias("start"))), lambda x: x["length"].isNotNull() & (
            x["start"] <= F.col("centre")) & (x["start"] + x["length"] >= F.col("centre")))
        best = around.select("phrase", "row", F.array_min(spans).alias("s")).where("s is not null")
        return best.select("phrase", "row", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.length") + 1).alias("end")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, text: str = "text", doc_id: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (xxhash64 of the text), n_words, n_hit, item_ids, contaminated.

    A word is hit when an exact window covers it; a text is contaminated from a ``share``-th of its words on.
    """
    phrases, ids = phrases_of(items, item_id, item_text)
    index = PositionalIndex(docs, phrases.select(F.explode("words").alias("word")), text, doc_id)
    found = stored(index.exact(phrases, window), "found")
    hits = found.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", "phrase").distinct().join(ids.where("item_id is not null"), "phrase").groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = hits.join(named, "row", "left")
    out = index.texts().join(both, "row", "left").select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
