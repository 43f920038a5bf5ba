"""I-Match fingerprints: the terms of a text that lie in a band of document frequency, hashed under many random lexicons.

1. The lexicon is every term whose inverse document frequency lies in a band. The band is a share of the
   documents, so the lexicon has at most (distinct terms of a mean text) / ``Band.least`` terms, whatever
   the number of documents.
2. A lexicon subset is drawn at random, once for all texts, by the digits of the term's hash: a level deals the
   lexicon to 1, 2, 8, 32, ... parts and keeps the first ones. The first level is the whole lexicon.
3. A text's distinct terms of a subset, sorted and hashed together, are one signature; its fingerprint is all of
   them. Equal signatures under dense subsets mean near-equal texts; under sparse ones they show how much is shared.

All of it is DataFrame functions. Frequencies are combined before they move. A text moves once, keyed by its id
and hash, and its terms are looked up and gathered where it lies. Nothing is gathered per term, source or language.

A null text is empty. Empty texts, and texts without a term in the band, have empty signatures; two of them are
alike (1.0), one of them and another text are not (0.0). Rows equal in id and text are told apart by nothing: they
follow each other. A null id is ordered behind all others. Rows with the same id are ordered by hash of the text.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.phrases import words
from tilewright.llm.shared import stored
from tilewright.operators.ordering import ranked

#: (bits, kept): the lexicon is dealt to 2**bits parts, the first ``kept`` of which are subsets. The bits of all levels are 36.
LEVELS = ((0, 1), (1, 2), (3, 8), (5, 32), (7, 32), (9, 32), (11, 32))
#: Lexicons of up to so many terms are broadcast; the band bounds them, longer ones are joined as Spark sees fit.
SMALL_LEXICON = 2_000_000


@dataclass(frozen=True)
class Band:
    """Terms in at least ``least`` and at most ``most`` of all documents; ``grace`` documents more, so that small tables keep terms."""

    least: float = 1 / 5000
    most: float = 1 / 100
    grace: int = 2


def lexicon(docs: DataFrame, band: Band = Band(), text: str = "text") -> DataFrame:
    """(term): the terms inside the band, over all documents."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("seen"))
    return stored(seen.where((F.col("seen") >= F.lit(band.least * n)) & (F.col("seen") - band.grace <= F.lit(band.most * n))).select("term"), "lexicon")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def signatures(terms: Column) -> Column:
    """A signature by subset, '' without terms, from the sorted distinct terms."""
    deals = F.transform(terms, lambda t: F.struct(t.alias("term"), F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("bigint").alias("deal")))
    lows = [36 - sum(bits for bits, _ in LEVELS[: i + 1]) for i in range(len(LEVELS))]
    return once(deals, lambda dealt: F.concat(*[_level(dealt, low, bits, kept) for low, (bits, kept) in zip(lows, LEVELS)]))


def _level(dealt: Column, low: int, bits: int, kept: int) -> Column:
    """The signatures of one level's subsets, in order."""
    part = lambda x: F.shiftright(x["deal"], low).bitwiseAND(F.lit((1 << bits) - 1))
    parts = F.transform(dealt, lambda x: F.struct(x["term"].alias("term"), part(x).alias("part")))
    if kept < 1 << bits:
        parts = F.filter(parts, lambda x: x["part"] < kept)
    held = lambda j: lambda mine: F.transform(F.filter(mine, lambda x: x["part"] == j), lambda x: x["term"])
    joined = once(parts, lambda mine: F.transform(F.sequence(F.lit(0), F.lit(kept - 1)), lambda j: F.array_join(held(j)(mine), " ")))
    return F.transform(joined, lambda t: F.when(t == "", t).otherwise(F.substring(F.md5(t), 1, 8)))


def printed(texts: DataFrame, keys: Sequence[str], known: DataFrame, carry: Sequence[str] = (), text: str = "text") -> DataFrame:
    """(keys, carry, print): a fingerprint for each row; ``keys`` tell the rows apart. Rows dealt by some of the keys are not moved."""
    head = F.lit("")  # no word is empty, so it stands for the text itself
    each = texts.select(*keys, *carry, F.explode(F.concat(F.array(head), F.array_distinct(words(F.col(text))))).alias("term"))
    each = each.select(*keys, "term", *[F.when(F.col("term") == head, F.col(c)).alias(c) for c in carry])
    known = known.select("term", F.lit(True).alias("known"))
    if known.count() <= SMALL_LEXICON:
        known = F.broadcast(known)
    met = each.join(known, "term", "left").where((F.col("term") == head) | F.col("known"))
    gathered = met.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carry], F.sort_array(F.collect_set(F.when(F.col("term") != head, F.col("term")))).alias("terms"))
    return gathered.withColumn("print", signatures(F.col("terms"))).drop("terms")


def shown(print_: Column) -> Column:
    return F.array_join(print_, ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among the subsets that hold a term of either text, 0 to 1.

    A level counts while no more than three quarters of its subsets hold a term: beyond, a subset holds many
    terms and one that differs hides all that agree. Where every level is as full as that, all count.
    """
    met = F.zip_with(a, b, lambda x, y: F.struct(((x != "") | (y != "")).cast("int").alias("some"), ((x == y) & (x != "")).cast("int").alias("same")))
    total = lambda items, name: F.aggregate(items, F.lit(0), lambda s, x: s + x[name])
    named = lambda **fields: F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])
    ends = [sum(kept for _, kept in LEVELS[:i]) for i in range(len(LEVELS))]
    levels = lambda m: F.array(*[named(some=total(F.slice(m, at + 1, kept), "some"), same=total(F.slice(m, at + 1, kept), "same"), kept=F.lit(kept))
                                 for at, (_, kept) in zip(ends, LEVELS)])
    sums = lambda items: named(some=total(items, "some"), same=total(items, "same"))
    sparse = lambda x: named(sparse=sums(F.filter(x, lambda v: 4 * v["some"] <= 3 * v["kept"])), all=sums(x))
    share = lambda x: F.when(x["sparse"]["some"] > 0, x["sparse"]["same"] / x["sparse"]["some"]).when(
        x["all"]["some"] > 0, x["all"]["same"] / x["all"]["some"]).otherwise(F.lit(1.0))
    return once(once(once(met, levels), sparse), share).cast("double")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, mark, doc_id, text): ``id`` and ``mark`` are never null and tell rows apart that differ in id or text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(F.col(doc_id).isNull(), whole).alias("mark"),
        F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"))


def followers(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, mark, n_chars, next_id, next_mark): the row behind each distinct row by descending id, the first behind the last. No text moves."""
    keys = _keyed(docs, text, doc_id).groupBy("id", "mark").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).cast("bigint").alias("n_chars"))
    # doc_id alone says which id 0 is null
    places = stored(ranked(keys, [], ["doc_id", "mark"], "place", descending=True), "places")
    n = places.count()
    behind = places.select((F.when(F.col("place") == 1, F.lit(n + 1)).otherwise(F.col("place")) - 1).alias("place"), F.col("id").alias("next_id"), F.col("mark").alias("next_mark"))
    return stored(places.join(behind, "place").select("id", "mark", "n_chars", "next_id", "next_mark"), "followers")


def half_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, mark, doc_id, n_chars, copies, next_id, next_mark, text, edited): one row for each distinct row and follower.

    ``edited`` is the text whose last floor(n_chars / 2) code points are those that the follower begins with. Of rows that
    agree in id and text, one has the next row behind it and the others (``copies``) have their own text.
    The texts are dealt out once, by id and mark; the beginnings of the followers travel to them.
    """
    after = followers(docs, text, doc_id)
    rows = _keyed(docs, text, doc_id).groupBy("id", "mark").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    wanted = after.select(F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), F.expr("n_chars div 2").alias("half"))
    # the same columns as below, so that both sides read one shuffle of the texts
    heads = rows.where("copies > 0 and (doc_id is null or doc_id = id)").join(wanted, ["id", "mark"]).select(
        F.col("to_id").alias("id"), F.col("to_mark").alias("mark"), F.expr("substring(text, 1, cast(half as int))").alias("head"))
    met = rows.where("copies > 0 and (doc_id is null or doc_id = id)").join(after, ["id", "mark"]).join(heads, ["id", "mark"])
    own = lambda head: F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), head)
    alone = (F.col("next_id") == F.col("id")) & (F.col("next_mark") == F.col("mark"))
    ways = F.array(
        F.struct(F.when(alone, F.col("copies")).otherwise(1).alias("copies"), F.col("next_id"), F.col("next_mark"), own(F.col("head")).alias("edited")),
        F.struct(F.when(alone, 0).otherwise(F.col("copies") - 1).alias("copies"), F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), own(F.expr("substring(text, 1, cast(n_chars div 2 as int))")).alias("edited")))
    return met.select("id", "mark", "doc_id", "n_chars", "text", F.explode(F.filter(ways, lambda w: w["copies"] > 0)).alias("w")).select(
        "id", "mark", "doc_id", "n_chars", "text", "w.*")


def edit_prints(docs: DataFrame, band: Band = Band(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next) of every row of ``docs``."""
    known = lexicon(docs, band, text)
    edits = half_edits(docs, text, doc_id)
    both = edits.select(
        "id", "mark", F.explode(F.array(
            F.struct(F.lit(False).alias("edit"), F.lit(0).cast("bigint").alias("way_id"), F.lit(0).cast("bigint").alias("way_mark"), F.col("text").alias("body")),
            F.struct(F.lit(True).alias("edit"), F.col("next_id").alias("way_id"), F.col("next_mark").alias("way_mark"), F.col("edited").alias("body")))).alias("b"),
        "doc_id", "n_chars", "copies").select("id", "mark", "b.edit", "b.way_id", "b.way_mark", "doc_id", "n_chars", "copies", "b.body").withColumn(
        "sha", F.sha2("body", 256))
    prints = printed(both, ["id", "mark", "edit", "way_id", "way_mark"], known, ["doc_id", "n_chars", "copies", "sha"], "body")
    # a text's own print and those of its edits lie in one task already; only the follower's print has to travel
    way = F.struct("doc_id", "n_chars", "copies", "sha", F.col("way_id").alias("next_id"), F.col("way_mark").alias("next_mark"), F.col("print").alias("edited_print"))
    paired = prints.groupBy("id", "mark").agg(F.max(F.when(~F.col("edit"), F.col("print"))).alias("print"), F.collect_list(F.when(F.col("edit"), way)).alias("ways"))
    rows = stored(paired.select("id", "mark", "print", F.posexplode("ways").alias("nth", "w")).select("id", "mark", "print", "nth", "w.*").withColumn(
        "near_edited", likeness(F.col("print"), F.col("edited_print"))), "prints")
    following = rows.where("nth = 0").select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("print").alias("next_print"))
    return rows.join(following, ["next_id", "next_mark"]).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "print", "edited_print", "near_edited",
        likeness(F.col("print"), F.col("next_print")).alias("near_next"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")
