"""What the physical plans do and do not contain."""

import contextlib
import io
import re

import pytest

from checks import pairs
from checks.queries import QUERIES
from concord import reconcile

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def exchanged(text: str) -> str:
    """Columns that go through a shuffle by key."""
    return " ".join(re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning", text))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Cross"):
        assert banned not in text


def test_status_moves_keys_and_hashes_only(spark):
    text = plan(QUERIES["status_breakdown"](spark, SF_DIR))
    moved = exchanged(text)
    assert "src_hash" in moved and "k_1" in moved
    assert "price" not in moved and "o_orderstatus" not in moved


def test_summary_does_not_move_long_texts(spark):
    r = reconcile(pairs.documents(spark, SF_DIR), pairs.documents_copy(spark, SF_DIR), pairs.documents_domain())
    moved = exchanged(plan(r.summary))
    assert "_short_src_text" in moved and not re.search(r"(?<!_short_)(?<!_number_)src_text", moved)


def test_nothing_runs_before_it_is_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    source, target = pairs.lineitems(spark, SF_DIR), pairs.lineitems_copy(spark, SF_DIR)
    spark.sparkContext.setJobGroup("lazy", "")
    try:
        r = reconcile(source, target, pairs.lineitems_domain())
        assert r.summary.columns and r.discrepancies.columns
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert list(tracker.getJobIdsForGroup("lazy")) == []


def test_one_shuffle_per_side_without_the_search_for_hot_keys(spark):
    r = reconcile(
        pairs.orders(spark, SF_DIR), pairs.orders_copy(spark, SF_DIR), pairs.orders_domain(), hot_rows=None
    )
    text = plan(r.discrepancies)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(k_1#\w+, \d+\)", text)
    assert len(moved) == 2 and text.count("SortMergeJoin") >= 1


def test_null_keys_are_found_in_the_scan(spark):
    text = plan(QUERIES["aligned_status"](spark, SF_DIR))
    assert "PushedFilters: [IsNull(o_orderkey)]" in text
    assert "PushedFilters: [IsNotNull(o_orderkey)" in text


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("scope_entity", "EqualTo(o_custkey,605)"),
        ("scope_range", "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)"),
        ("scope_period", "LessThan(o_orderdate,1996-09-18T00:00)"),
    ],
)
def test_scope_reaches_the_scan(spark, name, pushed):
    text = plan(QUERIES[name](spark, SF_DIR))
    scans = re.findall(r"PushedFilters: \[(.*)\]", text)
    assert scans and all(pushed in s for s in scans)


def test_tally_joins_nothing(spark):
    assert "Join" not in plan(QUERIES["composite_key_tally"](spark, SF_DIR))


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["key_audit"](spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
