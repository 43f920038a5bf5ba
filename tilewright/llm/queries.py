"""The registered queries over the corpus tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import (
    language_model, lexicon_prints, near_copies, nearest_vectors, packing, phrases, pivot_clusters, quality, repeats, secrets, source_audit, token_counts,
    token_output)
from tilewright.llm.oracles import ORACLES
from tilewright.llm.shared import table
from tilewright.session import scratch_path


def op1_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words."""
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words; a text is contaminated from a twentieth of its words on."""
    found = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 4096 ids; id 2 ends a document, id 0 pads."""
    return token_output.matrix(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, pad_id=0)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger over all documents; the documents are the paths."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs)
    found = ledger.of_paths(docs, ["doc_id"])
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [F.size(F.array_remove(F.array_remove(kinds, other), third)).cast("bigint").alias(f"n_{kind}")
              for kind, other, third in (("assign", "access", "hex"), ("access", "assign", "hex"), ("hex", "assign", "access"))]
    return found.select("doc_id", *counts, spans.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents outside fold 2 of 7."""
    return language_model.scores(table(spark, sf_dir, "documents"), quality.in_fold("doc_id", 7, 2))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 100."""
    return nearest_vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens; id 2 ends a document."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return packing.packed(cut.drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.in_fold("doc_id", 3, 1)))
    return quality.scored(docs, model).select(
        "doc_id", quality.in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.85 or more."""
    return near_copies.near_copies(table(spark, sf_dir, "documents"), near_copies.Rule(words=3, num=85, den=100))


def op11_lexicon_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in 1 of 5000 to 1 of 100 documents."""
    found = lexicon_prints.edit_prints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", lexicon_prints.shown(F.col("print")).alias("fingerprint"),
                        lexicon_prints.shown(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 centroids, three rounds, components times 64."""
    found = pivot_clusters.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of 30 documents of their language; 50 terms for each source."""
    return source_audit.audit(table(spark, sf_dir, "documents"), least_docs=30, most=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_words": op1_repeated_words,
    "op2_token_counts": op2_token_counts,
    "op3_phrases": op3_phrases,
    "op4_token_matrix": op4_token_matrix,
    "op5_secrets": op5_secrets,
    "op6_language_model": op6_language_model,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_near_copies": op10_near_copies,
    "op11_lexicon_prints": op11_lexicon_prints,
    "op12_pivot_clusters": op12_pivot_clusters,
    "op13_source_audit": op13_source_audit,
}

__all__ = ["ORACLES", "QUERIES"]
