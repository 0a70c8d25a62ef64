"""Registered queries against their SQL, their held-out quality, and the pipeline's stages."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, difference
from concord.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) is None


def test_registered(spark):
    import __spark_entry__ as contract

    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang is not None]
    assert sum(held) / len(held) > 0.97


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op10_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted for r in rows if r.quality == 1) / len(good) > 0.97


def test_nearest_recall(spark):
    import numpy as np

    items = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.stack(items.embedding).astype(float)
    got = QUERIES["op2_nearest"](spark, "/root/testdata/sf0.1").toPandas().groupby("query_id").vec_id.apply(set)
    recall = []
    for i, q in enumerate(items.vec_id):
        if q % 20 == 0:
            score = x @ x[i]
            score[i] = -np.inf
            recall.append(len(set(items.vec_id.to_numpy()[np.argsort(-score)[:20]]) & got[q]) / 20)
    assert np.mean(recall) >= 0.95


def test_pipeline(spark, tmp_path):
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= left
        assert docs.where("n_chars <> length(text)").count() == 0
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.n for r in tokens} == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_stages_on_odd_and_empty_tables(spark, stored_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (stored_docs, no_docs):
            out = stage(spark, docs, SF_DIR)
            n = out.count()
            assert name == "packing" or out.columns == docs.columns
            assert n == 0 if docs is no_docs else n > 0
