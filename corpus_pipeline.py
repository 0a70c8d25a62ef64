"""Training corpus from `documents`: rejected texts and near copies go, benchmark passages and personal
data are taken out, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, jaccard_join, packing, pii, quality
from concord.llm.queries import THRESHOLD, TOKENIZER, table
from concord.llm.storage import crc_bucket, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier does not reject; it is fitted on the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    name = "__quality"
    return quality.scored(docs, model, out=name).where(F.col(name) >= THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near copies."""
    return jaccard_join.representatives(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark items share with them."""
    return _counted(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"), 10))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token pieces, placed in sequences of 1024."""
    return packing.packed(docs, TOKENIZER, 1024, 2)


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars`, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", cut_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
