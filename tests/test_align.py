"""Alignment against a plain-Python join: repeated keys, NULL keys, hot keys."""

import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord import reconcile
from concord.operators.align import align, has_null_key, hot_keys, key_tally, one_sided
from concord.operators.hashview import prepare
from concord.plans.reconcile import Result, clear_written, rare_discrepancies
from helpers import brute_force, counted, domain, frame

AMOUNTS = [None, Decimal("0.00"), Decimal("100.00"), Decimal("100.50"), Decimal("-100.00"), Decimal("250.00")]
NOTES = [None, "a", "b", "7", "7.0", "NaN", "x" * 80, "x" * 79 + "y", "0" * 70 + "7"]


def sample(rng, n, keys, hot_key=None, share=0.0, null_share=0.1):
    rows = []
    for _ in range(n):
        if rng.random() < share:
            key = hot_key
        else:
            key = tuple(None if rng.random() < null_share else rng.randrange(12) for _ in range(keys))
        rows.append((*key, rng.choice(AMOUNTS), rng.choice(NOTES)))
    return rows


@pytest.mark.parametrize("keys", [1, 2])
@pytest.mark.parametrize("hot_rows", [None, 1, 5])
def test_random_pairs(spark, keys, hot_rows):
    rng = random.Random(keys * 100 + (hot_rows or 0))
    src, tgt = sample(rng, 60, keys), sample(rng, 50, keys)
    r = reconcile(frame(spark, src, keys), frame(spark, tgt, keys), domain(keys=keys), hot_rows=hot_rows)
    assert counted(r.judged, keys) == brute_force(src, tgt, keys)


@pytest.mark.parametrize("cell_rows", [1, 3, 1000])
def test_one_key_holds_a_third_of_both_sides(spark, cell_rows):
    rng = random.Random(7)
    src = sample(rng, 240, 1, hot_key=(5,), share=0.4)
    tgt = sample(rng, 200, 1, hot_key=(5,), share=0.4)
    d = domain()
    p = prepare(frame(spark, src), frame(spark, tgt), d)
    assert 5 in {row["k_1"] for row in hot_keys(p, 40).collect()}
    rows = align(p, 40, cell_rows)
    r = Result(d, p.source, p.target, p, rows)
    assert counted(r.judged) == brute_force(src, tgt)
    # Copies are counted, not repeated: one line per pair of distinct rows.
    of_key = rows.where("k_1 = 5")
    shape = of_key.agg(F.count("*").alias("lines"), F.sum("copies").alias("pairs")).first()
    s, t = [x for x in src if x[0] == 5], [x for x in tgt if x[0] == 5]
    assert shape["pairs"] == len(s) * len(t)
    assert shape["lines"] == len(set(s)) * len(set(t))


@pytest.mark.parametrize("hot_side", ["source", "target"])
def test_hot_key_on_one_side_only(spark, hot_side):
    rng = random.Random(11)
    many = sample(rng, 150, 1, hot_key=(99,), share=0.5)
    few = sample(rng, 30, 1)
    src, tgt = (many, few) if hot_side == "source" else (few, many)
    r = reconcile(frame(spark, src), frame(spark, tgt), domain(), hot_rows=20)
    assert counted(r.judged) == brute_force(src, tgt)


def test_hot_key_against_a_single_row(spark):
    src = [(1, Decimal(i), "n") for i in range(200)] + [(2, Decimal(1), "n")]
    tgt = [(1, Decimal(5), "n"), (3, Decimal(1), "n")]
    d = domain()
    p = prepare(frame(spark, src), frame(spark, tgt), d)
    r = Result(d, p.source, p.target, p, align(p, 100, cell_rows=10))
    assert counted(r.judged) == brute_force(src, tgt)


def test_copies_of_one_row_are_counted_before_they_meet(spark):
    src = [(1, Decimal(5), "n")] * 300
    tgt = [(1, Decimal(5), "n")] * 200 + [(1, Decimal(6), "n")]
    r = reconcile(frame(spark, src), frame(spark, tgt), domain(), hot_rows=100)
    assert r.aligned.count() == 2
    s = r.summary.first()
    assert (s["matched"], s["mismatched"], s["total_source"], s["total_target"]) == (60_000, 300, 300, 201)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_any_pair(spark, data):
    row = st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from(AMOUNTS), st.sampled_from(NOTES))
    src = data.draw(st.lists(row, max_size=12))
    tgt = data.draw(st.lists(row, max_size=12))
    hot_rows = data.draw(st.sampled_from([None, 2]))
    r = reconcile(frame(spark, src), frame(spark, tgt), domain(), hot_rows=hot_rows)
    assert counted(r.judged) == brute_force(src, tgt)


def test_short_and_full_texts_judge_alike(spark):
    rng = random.Random(3)
    src, tgt = sample(rng, 80, 1), sample(rng, 80, 1)
    r = reconcile(frame(spark, src), frame(spark, tgt), domain(), hot_rows=None)
    columns = ["k_1", "src_hash", "tgt_hash", "status", "verdict", "strict_verdict", "matching_fields", "max_variance"]
    full = r.discrepancies.select(*columns)
    short = r.judged.where("status <> 'MATCH'").select(*columns)
    assert full.exceptAll(short).isEmpty() and short.exceptAll(full).isEmpty()


def test_null_source_key_is_source_only(spark):
    src, tgt = [(None, Decimal(1), "a")], [(None, Decimal(1), "a")]
    rows = reconcile(frame(spark, src), frame(spark, tgt), domain()).aligned.collect()
    assert sorted(r["status"] for r in rows) == ["SOURCE_ONLY", "TARGET_ONLY"]


def test_null_keys_stay_out_of_the_join(spark):
    src, tgt = [(None, Decimal(i), "a") for i in range(50)], [(1, Decimal(1), "a")]
    p = prepare(frame(spark, src), frame(spark, tgt), domain())
    assert hot_keys(p, 10).isEmpty()
    assert p.source.where(has_null_key(p.keys)).count() == p.loose()[0].count() == 50
    assert align(p).groupBy("status").agg(F.sum("copies").alias("n")).where("status = 'SOURCE_ONLY'").first()["n"] == 50


def test_one_frame_for_every_split(spark):
    """A key with 35 rows against 24, and more split keys than any constant."""
    src = [(1, AMOUNTS[i % 4], NOTES[i % 3]) for i in range(35)] + [(100 + i % 40, AMOUNTS[i % 3], None) for i in range(200)]
    tgt = [(1, AMOUNTS[i % 3], NOTES[i % 4]) for i in range(24)] + [(100 + i % 40, AMOUNTS[i % 5], None) for i in range(160)]
    src += [(None, Decimal(1), "a")] * 3
    frames = []
    for hot_rows in (None, 2, 10, 1000):
        r = reconcile(frame(spark, src), frame(spark, tgt), domain(), hot_rows=hot_rows)
        rows = r.aligned
        frames.append(sorted(map(str, rows.select(sorted(rows.columns)).collect())))
        assert counted(r.judged) == brute_force(src, tgt)
        s = r.summary.first()
        assert (s["total_source"], s["total_target"]) == (len(src), len(tgt))
    assert all(f == frames[0] for f in frames)


def test_signs_of_zero_stay_apart(spark):
    from concord import Domain, Field, Side

    side = Side("t", (Field("id", "INT"),), (Field("v", "DOUBLE"),))
    df = spark.createDataFrame([(1, -0.0), (1, 0.0), (1, 0.0)], "id int, v double")
    rows = reconcile(df, df.limit(0), Domain("z", side, side)).aligned.collect()
    assert sorted((str(r["src_v"]), r["copies"]) for r in rows) == [("-0.0", 1), ("0.0", 2)]


def test_one_sided_and_tally(spark):
    rng = random.Random(5)
    src, tgt = sample(rng, 60, 1), sample(rng, 60, 1)
    p = prepare(frame(spark, src), frame(spark, tgt), domain())
    want = brute_force(src, tgt)
    s_only, t_only = one_sided(p)
    assert s_only.count() == sum(n for k, n in want.items() if k[3] == "SOURCE_ONLY")
    assert t_only.count() == sum(n for k, n in want.items() if k[3] == "TARGET_ONLY")
    tally = key_tally(p).agg(
        *[F.sum(c).alias(c) for c in ("source_rows", "target_rows", "matched", "mismatched", "source_only", "target_only")]
    ).first()
    assert (tally["source_rows"], tally["target_rows"]) == (60, 60)
    for column, status in (
        ("matched", "MATCH"), ("mismatched", "MISMATCH"), ("source_only", "SOURCE_ONLY"), ("target_only", "TARGET_ONLY")
    ):
        assert tally[column] == sum(n for k, n in want.items() if k[3] == status)


def test_rare_discrepancies_are_all_discrepancies(spark, tmp_path):
    rng = random.Random(9)
    src, tgt = sample(rng, 60, 1), sample(rng, 60, 1)
    s, t = frame(spark, src), frame(spark, tgt)
    plain = reconcile(s, t, domain()).discrepancies
    rare = rare_discrepancies(s, t, domain(), folder=str(tmp_path))
    written = list(tmp_path.glob("odd-keys-*"))
    assert written
    assert rare.columns == plain.columns
    assert rare.exceptAll(plain).isEmpty() and plain.exceptAll(rare).isEmpty()
    clear_written(rare)
    assert not any(f.exists() for f in written)


def test_set_difference_agrees(spark):
    """Rows missing or changed either way are what exceptAll finds when keys are unique."""
    src = [(i, Decimal(i), "a") for i in range(40)]
    tgt = [(i, Decimal(i if i % 7 else i + 1), "a") for i in range(5, 45)]
    s, t = frame(spark, src), frame(spark, tgt)
    r = reconcile(s, t, domain())
    statuses = {row["status"]: row["records"] for row in r.aligned.groupBy("status").agg(F.sum("copies").alias("records")).collect()}
    assert statuses["MISMATCH"] + statuses["SOURCE_ONLY"] == s.exceptAll(t).count()
    assert statuses["MISMATCH"] + statuses["TARGET_ONLY"] == t.exceptAll(s).count()


def test_checkpointed(spark):
    src = [(i, Decimal(i), "a") for i in range(20)]
    r = reconcile(frame(spark, src), frame(spark, src[:15]), domain())
    c = r.checkpointed()
    assert c.summary.first() == r.summary.first()
    assert c.discrepancies.count() == 5
