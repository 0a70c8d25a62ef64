"""Pages of a stored list against the list itself."""

import random

import pytest

from concord import reconcile
from concord.operators.discrepancies import line_order, lines_of, page
from concord.plans.listing import stored_listing
from helpers import domain, frame
from test_align import sample


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    return reconcile(frame(spark, sample(rng, 120, 1)), frame(spark, sample(rng, 120, 1)), domain()).discrepancies


def test_pages_follow_on_one_another(spark, found, tmp_path):
    want = [tuple(r) for r in lines_of(found).orderBy(*line_order(found)).collect()]
    listing = stored_listing(found, str(tmp_path), file_lines=10)
    assert listing.files.count() > 5 and len(list(tmp_path.glob("listing-*"))) == 2
    got, last = [], None
    while rows := listing.page(23, last).collect():
        got += [tuple(r) for r in rows]
        last = rows[-1]
    assert got == want
    assert [tuple(r) for r in page(found, 23).collect()] == want[:23]


def test_a_page_opens_the_files_of_its_range(spark, found, tmp_path):
    listing = stored_listing(found, str(tmp_path), file_lines=10)
    first = listing.page(5)
    assert len(first.inputFiles()) <= listing.files.count()
    read = first._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("part-") <= 2
    second = listing.page(5, first.collect()[-1])
    assert second._jdf.queryExecution().optimizedPlan().toString().count("part-") <= 3


def test_no_lines(spark, tmp_path):
    same = frame(spark, [(1, None, "a")])
    listing = stored_listing(reconcile(same, same, domain()).discrepancies, str(tmp_path))
    assert listing.page(10).isEmpty()
