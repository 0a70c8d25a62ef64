"""Digest trees and late reading against the plain ways, on repeated and NULL keys."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concord import reconcile
from concord.operators.hashview import prepare
from concord.operators.locate import FILE, ROW, fetch, located, lots, marks
from concord.plans import reconcile as plans
from concord.plans.drilldown import differing, drilldown, leaves
from concord.plans.reconcile import clear_written, late_discrepancies, rare_discrepancies
from helpers import domain, frame
from test_align import sample
from test_plans import exchanged, plan


def statuses(df, keys):
    out = Counter()
    for r in df.collect():
        out[tuple(r[f"k_{i + 1}"] for i in range(keys)), r["src_hash"], r["tgt_hash"], r["status"]] += r["copies"]
    return out


@pytest.mark.parametrize("keys", [1, 2])
@pytest.mark.parametrize("bits", [4, 12])
def test_repeated_and_null_keys(spark, keys, bits):
    rng = random.Random(keys + bits)
    src = sample(rng, 80, keys)
    tgt = [r if rng.random() < 0.8 else (*r[:keys], Decimal("1.00"), "new") for r in src[6:]] + sample(rng, 6, keys)
    s, t = frame(spark, src, keys), frame(spark, tgt, keys)
    found = drilldown(s, t, domain(keys=keys), bits=bits, hot_rows=5)
    plain = reconcile(s, t, domain(keys=keys))
    assert found.match_counts.first() == plain.match_counts.first()
    assert statuses(found.statuses, keys) == statuses(plain.statuses.where("status <> 'MATCH'"), keys)
    one = [statuses(f.withColumn("status", F.lit(side)).withColumn("copies", F.lit(1)).withColumn(other, F.lit(None)), keys) for f, side, other in zip(found.one_sided, ("S", "T"), ("tgt_hash", "src_hash"))]
    want = statuses(plain.statuses.where("status LIKE '%ONLY'"), keys)
    assert sum(one[0].values()) + sum(one[1].values()) == sum(want.values())


def test_rows_without_stored_hash(spark):
    rows = [(i, Decimal(i), "a") for i in range(30)]
    df = frame(spark, rows).withColumn("record_hash", F.when(F.col("id1") % 3 != 0, F.md5("note")))
    for unique in (True, False):
        found = drilldown(df, df, domain(), unique_keys=unique, use_hash_column=True)
        counts = found.match_counts.first()
        assert (counts.matched, counts.mismatched) == (20, 10)
        assert found.statuses.count() == 10


def test_unique_keys_and_empty_sides(spark):
    src = [(i, Decimal(i), "a") for i in range(200)]
    tgt = [(i, Decimal(i if i % 50 else i + 1), "a") for i in range(3, 205)]
    for a, b in ((src, tgt), (src, src), ([], tgt), (src, []), ([], [])):
        s, t = frame(spark, a), frame(spark, b)
        assert drilldown(s, t, domain(), unique_keys=True).match_counts.first() == reconcile(s, t, domain()).match_counts.first()


def test_only_leaves_that_differ_are_found(spark):
    p = prepare(frame(spark, [(i, Decimal(i), "a") for i in range(500)]), frame(spark, [(i, Decimal(i + (i == 77)), "a") for i in range(500)]), domain())
    trees = [leaves(side, p.keys, h, 12) for side, h in ((p.source, "src_hash"), (p.target, "tgt_hash"))]
    assert sum(r["rows"] for r in trees[0].collect()) == 500
    assert differing(*trees, 12).count() == 1
    assert differing(trees[0], trees[0], 12).isEmpty()
    with pytest.raises(ValueError):
        leaves(p.source, p.keys, "src_hash", 10)


def test_second_pass_looks_at_differing_leaves_only(spark):
    src = frame(spark, [(i, Decimal(i), "a") for i in range(2000)])
    tgt = frame(spark, [(i, Decimal(i + (i == 77)), "a") for i in range(2000)])
    found = drilldown(src, tgt, domain(), unique_keys=True)
    assert found.suspects.source.count() < 20 and found.suspects.target.count() < 20
    text = plan(found.statuses)
    # Both sides meet the stored leaf numbers before anything is shuffled by key.
    assert "LeftSemi" in text and "odd-buckets" in text and "amount" not in exchanged(text)
    assert found.statuses.collect()[0]["k_1"] == 77


# Late reading


@pytest.fixture()
def stored(spark, tmp_path):
    rng = random.Random(12)
    src = sample(rng, 200, 1) + [(1000 + i, Decimal(i), "wide" * 20) for i in range(300)]
    tgt = [r if rng.random() < 0.9 else (*r[:1], Decimal("3.00"), "other") for r in src]
    paths = [str(tmp_path / n) for n in ("src", "tgt")]
    for rows, path in zip((src, tgt), paths):
        frame(spark, rows).repartition(5).write.parquet(path)
    return [spark.read.parquet(p) for p in paths]


def test_late_discrepancies_are_all_discrepancies(spark, stored, tmp_path):
    s, t = stored[0].where("amount IS NULL OR amount <> 7"), stored[1].withColumn("note", F.upper("note"))
    plain = reconcile(s, t, domain()).discrepancies
    late = late_discrepancies(s, t, domain(), folder=str(tmp_path))
    assert late.columns == plain.columns
    assert late.exceptAll(plain).isEmpty() and plain.exceptAll(late).isEmpty()
    assert "late" not in exchanged(plan(late))
    written = list(tmp_path.glob("odd-*"))
    assert len(written) == 3
    clear_written(late)
    assert not any(f.exists() for f in tmp_path.glob("odd-places-*"))


def test_sides_without_places(spark, stored):
    joined = stored[0].join(spark.range(2000).withColumnRenamed("id", "id1"), "id1", "left")
    assert located(joined) is None
    plain, late = reconcile(joined, stored[1], domain()).discrepancies, late_discrepancies(joined, stored[1], domain())
    assert late.exceptAll(plain).isEmpty() and plain.exceptAll(late).isEmpty()
    with pytest.raises(ValueError):
        fetch(joined, stored[0])


@pytest.mark.parametrize("rows", [7, 60, 10_000])
def test_fetch_in_lots(spark, stored, rows, tmp_path):
    whole = located(stored[0])
    path = str(tmp_path / "wanted")
    whole.where("id1 % 3 = 0").select(FILE, ROW).write.parquet(path)
    wanted = spark.read.parquet(path)
    got, want = fetch(stored[0], wanted, rows), stored[0].where("id1 % 3 = 0")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    cut = lots(wanted, rows)
    assert (len(cut) > 5) == (rows == 7) and (len(cut) == 1) == (rows == 10_000)
    assert "Exchange hashpartitioning" not in plan(got)
    assert fetch(stored[0], wanted.limit(0)).isEmpty()


def test_only_files_with_wanted_rows_are_opened(spark, stored, tmp_path):
    whole = located(stored[0])
    file = whole.first()[FILE]
    path = str(tmp_path / "wanted")
    whole.where(F.col(FILE) == file).limit(3).select(FILE, ROW).write.parquet(path)
    assert len(fetch(stored[0], spark.read.parquet(path)).select("*").collect()) == 3
    assert lots(spark.read.parquet(path))[0].files == [file]


def test_marks_do_not_grow_with_wanted_rows(spark, tmp_path):
    """A driver with all locators of many lots ran out of memory; their bits are few, and one scan serves them."""
    spark.range(700_000).withColumn("v", F.col("id") * 3).coalesce(1).write.parquet(str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side"))
    places = located(side).select("id", FILE, ROW)
    for i, rule in enumerate(("id % 64 IN (0, 63) OR id % 32768 IN (1, 32767)", "id % 8 <> 5", "id = 699999", "true")):
        path = str(tmp_path / f"marks-{i}")
        wanted = places.where(rule).select(FILE, ROW)
        marks(wanted.unionAll(wanted)).write.parquet(path)
        stored = spark.read.parquet(path)
        assert stored.count() == (1 if "=" in rule and "%" not in rule else 22)
        got = fetch(side, stored)
        assert plan(got).count("BroadcastHashJoin") == plan(side.join(F.broadcast(side), "id")).count("BroadcastHashJoin")
        assert got.agg(F.count("*"), F.sum("id"), F.sum("v")).first() == side.where(rule).agg(F.count("*"), F.sum("id"), F.sum("v")).first()
        assert got.exceptAll(side.where(rule)).isEmpty()


def test_many_keys_are_not_sent_to_the_driver(spark, stored, monkeypatch):
    monkeypatch.setattr(plans, "SENT_KEYS", 5)
    rare = rare_discrepancies(*stored, domain(), hot_rows=None)
    assert "BroadcastExchange" not in plan(rare)
    want = reconcile(*stored, domain()).discrepancies
    assert rare.exceptAll(want).isEmpty() and want.exceptAll(rare).isEmpty()
