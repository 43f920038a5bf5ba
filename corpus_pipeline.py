"""From raw documents to packed token sequences: quality, near copies, benchmark passages, secrets, packing.

Every stage but the last returns the columns of ``documents``. Rows that repeat a doc_id, null ids and null
texts pass through every stage as rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import near_copies, packing, phrases, quality, secrets
from tilewright.llm.queries import vocabulary
from tilewright.llm.shared import stored, table, unused
from tilewright.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    return quality.scored(docs, model, keep=docs.columns, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8); a document without words is no copy."""
    return near_copies.one_of_each(docs, near_copies.Rule(words=5, num=80, den=100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    found = phrases.contamination(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)
    gone, mark = unused("gone", docs.columns), unused("mark", docs.columns)
    hit = stored(found.where("contaminated").select(F.col("doc_id").alias(gone), F.col("mark").alias(mark)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(gone)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(mark))
    return docs.join(hit, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; ``n_chars`` follows the text."""
    ledger = secrets.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs)
    spans = unused("found", docs.columns)
    found = ledger.of_paths(docs, docs.columns, out=spans)
    hit = F.size(spans) > 0
    return found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans))).withColumn(
        "n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in windows of 4096 tokens."""
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return packing.packed(cut.drop("ids")).drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_low_quality),
    ("near_copies", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: A trained model, an iterated component search and a packing heuristic decide the rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
