"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import ann, decontaminate, hard_negatives, jaccard_join, kmeans, language, packing, phrase_dedup, pii, quality, sentence_pieces, suffix_dedup, warc
from concord.llm.oracle import ORACLE
from concord.llm.storage import crc_bucket, new_path, shipped

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    placed = packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, 1024, 2)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left when strings of 200 that recur are removed."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"), 200)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    model = language.train(docs.where("NOT held_out"))
    return language.predicted(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when passages of 20 that occurred earlier are removed."""
    return phrase_dedup.removed(table(spark, sf_dir, "documents"), 20)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8."""
    return jaccard_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    counts = [F.expr(f"bigint(size(filter(pii, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four fifths."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    scored = quality.scored(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in 40 clusters after five rounds."""
    return kmeans.clustered(table(spark, sf_dir, "embeddings"), centroids=40, rounds=5, width=64, scale=256, seed=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; a seventh of the labels is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mined(items, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they give."""
    found = sentence_pieces.encoded(table(spark, sf_dir, "documents"), PIECES)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language": op5_language,
    "op6_phrase_dedup": op6_phrase_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_kmeans": op11_kmeans,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentence_pieces": op13_sentence_pieces,
}

__all__ = ["ORACLE", "QUERIES"]
