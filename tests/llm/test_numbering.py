"""Rows keep their numbers when Spark packs the input's files differently in a later job, as it does when the number of cores changes."""

from collections import Counter
from contextlib import contextmanager

import pytest
from test_dedup import without_bytes, without_words
from test_jaccard import brute
from test_warc import PAGES, expected, round_trip

from concord.llm import jaccard_join, phrase_dedup, suffix_dedup, warc
from concord.llm.storage import new_path

PACKING = "spark.sql.files.maxPartitionBytes"


@contextmanager
def packed(spark, size):
    spark.conf.set(PACKING, size)
    try:
        yield
    finally:
        spark.conf.unset(PACKING)


@pytest.mark.parametrize("size", ["2k", "20k"])
def test_removed(spark, stored_docs, odd_texts, size):
    words, by_bytes = phrase_dedup.removed(stored_docs, 20), suffix_dedup.removed(stored_docs, 60)
    with packed(spark, size):
        assert Counter(tuple(r) for r in words.collect()) == without_words(odd_texts, 20)
        assert Counter(tuple(r) for r in by_bytes.collect()) == without_bytes(odd_texts, 60)


def test_joined(spark, stored_docs, odd_texts):
    found, left = jaccard_join.joined(stored_docs).select("doc_id", "class_id", "n_links"), jaccard_join.representatives(stored_docs)
    usual = Counter(r.doc_id for r in left.collect())
    with packed(spark, "2k"):
        assert Counter(tuple(r) for r in found.collect()) == brute(odd_texts)
        assert Counter(r.doc_id for r in left.collect()) == usual


def test_warc(spark):
    read = warc.read(spark, round_trip(spark, PAGES))
    with packed(spark, "40k"):
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()), key=str)
    assert got == expected(PAGES)


def test_written_rows_are_numbered_once(spark, stored_docs, monkeypatch):
    """`write` reads its rows for the digests and again for the payloads, and both must see the same numbers."""
    frames = []
    join = type(stored_docs).join
    monkeypatch.setattr(type(stored_docs), "join", lambda self, *a, **k: frames.append(self) or join(self, *a, **k))
    warc.write(stored_docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html"), new_path(spark, "warc-numbers"))
    assert frames and "monotonically_increasing_id" not in frames[0]._jdf.queryExecution().analyzed().toString()
