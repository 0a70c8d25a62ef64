"""Small worked scenarios with the counts they should give."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concord import Domain, Enrichment, Field, Side, reconcile
from concord.operators.enrich import enrich, enrich_side
from concord.operators import scope
from helpers import domain, frame

KEY = "550e8400-e29b-41d4-a716-446655440"
INVOICE = "id string, vendor_name string, amount decimal(15,2), billing_cycle date, line_item_id string, created_at timestamp_ntz"
DAY = date(2024, 1, 15)


def invoice(n, amount, line, created=datetime(2024, 1, 15)):
    return (f"{KEY}{n:03d}", "Acme Corp", Decimal(amount), DAY, line, created)


def invoices():
    fields = (Field("vendor_name"), Field("amount", "DECIMAL"), Field("line_item_id"))
    side = Side("vendor_invoices", (Field("id"),), fields, schema="finance", view_suffix="_with_hash")
    return Domain("vendor-invoices", side, side)


@pytest.mark.parametrize(
    ("src", "tgt", "expected"),
    [
        ([invoice(1, "1500.50", "LI001")], [invoice(1, "1500.50", "LI001")], (1, 1, 1, 0, 0, 0)),
        (
            [invoice(2, "1500.50", "LI002", datetime(2024, 2, 1))],
            [invoice(2, "1500.50", "LI002")],
            (1, 1, 1, 0, 0, 0),
        ),
        ([invoice(3, "1500.50", "LI003")], [invoice(3, "1600.75", "LI003")], (1, 1, 0, 1, 0, 0)),
        (
            [invoice(4, "1", "LI004"), invoice(5, "5000.00", "LI005"), invoice(6, "2", "LI006")],
            [invoice(4, "1", "LI004"), invoice(5, "5500.00", "LI005"), invoice(6, "2", "LI006")],
            (3, 3, 2, 1, 0, 0),
        ),
        (
            [invoice(7, "1", "LI007"), invoice(9, "3", "LI009")],
            [invoice(8, "2", "LI008"), invoice(9, "3", "LI009")],
            (2, 2, 1, 0, 1, 1),
        ),
    ],
    ids=["pristine", "other-field", "hash-field", "mixed", "one-sided"],
)
def test_scenarios(spark, src, tgt, expected):
    r = reconcile(spark.createDataFrame(src, INVOICE), spark.createDataFrame(tgt, INVOICE), invoices())
    s = r.summary.first()
    got = tuple(
        s[c] for c in ("total_source", "total_target", "matched", "mismatched", "source_only", "target_only")
    )
    assert got == expected
    assert s["pristine"] == s["matched"]
    assert s["total_discrepancies"] == r.discrepancies.count()


def test_ledger_rows_by_line_item(spark):
    schema = "vendor_name string, amount decimal(15,2), billing_cycle date, line_item_id string"
    april, march = date(2026, 4, 1), date(2026, 3, 1)
    both = [
        ("Vendor A", Decimal("1500.00"), april, "LINE001"),
        ("Vendor B", Decimal("2500.50"), april, "LINE002"),
        ("Vendor C", None, april, "LINE003"),
    ]
    side = Side("ledger", (Field("line_item_id"),), (Field("vendor_name"), Field("amount", "NUMERIC")))
    r = reconcile(
        spark.createDataFrame([*both, ("Vendor A", Decimal("1200.00"), march, "LINE004")], schema),
        spark.createDataFrame([*both, ("Vendor D", Decimal("3000.00"), april, "LINE005")], schema),
        Domain("ledger", side, side),
    )
    s = r.summary.first()
    assert (s["matched"], s["source_only"], s["target_only"]) == (3, 1, 1)
    assert s["match_pct"] == 75.0 and not s["passed"] and not s["acceptable"] and s["needs_approval"]


def test_empty_sides_match_fully(spark):
    empty = frame(spark, [])
    s = reconcile(empty, empty, domain()).summary.first()
    assert s["match_pct"] == 100.0 and s["passed"] and s["acceptable"] and not s["needs_approval"]
    assert all(s[c] == 0 for c in ("total_source", "total_target", "matched", "material", "noisy", "pristine"))


def test_one_empty_side(spark):
    s = reconcile(frame(spark, [(1, Decimal(1), "a")]), frame(spark, []), domain()).summary.first()
    assert (s["source_only"], s["match_pct"]) == (1, 0.0)


def test_heterogeneous_names_and_types(spark):
    src = spark.createDataFrame(
        [(1, 10, Decimal("99.50"), date(2024, 1, 5)), (2, 11, Decimal("20.00"), date(2024, 1, 6))],
        "order_id int, customer_id int, order_amount decimal(10,2), order_date date",
    )
    tgt = spark.createDataFrame(
        [(1, 10, Decimal("99.5000"), datetime(2024, 1, 5, 13)), (2, 11, Decimal("21.0000"), datetime(2024, 1, 6))],
        "ORDER_NO int, CUST_ID int, TXN_AMT decimal(12,4), TXN_DATE timestamp_ntz",
    )
    d = Domain(
        "sales-orders",
        Side("o", (("order_id", "INTEGER"),), (("customer_id", "INTEGER"), ("order_amount", "NUMERIC"), ("order_date", "DATE"))),
        Side("t", (("order_no", "INTEGER"),), (("cust_id", "INTEGER"), ("txn_amt", "NUMERIC"), ("txn_date", "DATE"))),
    )
    rows = {r["k_1"]: r for r in reconcile(src, tgt, d).judged.collect()}
    assert rows[1]["status"] == "MATCH"
    assert (rows[2]["status"], rows[2]["max_variance"], rows[2]["verdict"]) == ("MISMATCH", 5.0, "MATERIAL")


def test_field_mapping_reorders_pairs():
    d = Domain(
        "m", Side("s", ("id",), ("a", "b")), Side("t", ("id",), ("y", "x")), field_mappings={"a": "x", "b": "y"}
    )
    assert [(a.name, b.name) for a, b in d.field_pairs()] == [("a", "x"), ("b", "y")]
    bad = Domain("m", Side("s", ("id",), ("a",)), Side("t", ("id",), ("x",)), field_mappings={"a": "z"})
    with pytest.raises(ValueError, match="a -> z"):
        bad.field_pairs()


def test_repeated_keys_multiply(spark):
    src = [(1, Decimal(1), "a"), (1, Decimal(2), "a")]
    tgt = [(1, Decimal(1), "a")] * 3
    s = reconcile(frame(spark, src), frame(spark, tgt), domain()).summary.first()
    assert (s["total_source"], s["total_target"], s["matched"], s["mismatched"]) == (2, 3, 3, 3)


def test_enrichment(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, cust int")
    ref = spark.createDataFrame([(10, "EU", 1), (10, "US", 2)], "c int, region string, rank int")
    left = enrich(df, ref, "cust", "c", "left", ("region",))
    assert left.columns == ["id", "cust", "region"]
    assert sorted((r["id"], r["region"] or "") for r in left.collect()) == [(1, "EU"), (1, "US"), (2, ""), (3, "")]
    assert enrich(df, ref, "cust", "c", "inner").count() == 2
    with pytest.raises(ValueError):
        enrich(df, ref, "cust", "c", "full")
    with pytest.raises(ValueError):
        enrich(df, df.withColumnRenamed("id", "k"), "id", "k")
    side = Side("t", joins=(Enrichment("ref", "cust", "c", "INNER", ("region",)),))
    assert enrich_side(df, side, lambda name: {"ref": ref}[name]).count() == 2


def test_scope(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 31, 23, 59, 59), date(2024, 1, 31)), (2, datetime(2024, 2, 1), date(2024, 2, 1))],
        "id int, at timestamp_ntz, day date",
    )
    for column in ("at", "day"):
        assert [r["id"] for r in scope.period(df, column, "2024-01-31").collect()] == [1]
        assert scope.date_range(df, column, "2024-01-31", date(2024, 2, 1)).count() == 2
    zoned = df.select("id", F.col("at").cast("timestamp").alias("at"))
    assert [r["id"] for r in scope.period(zoned, "at", "2024-02-01").collect()] == [2]
    assert [r["id"] for r in scope.entity(df, "id", 2).collect()] == [2]


def test_scope_of_a_pair(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id int, vendor string")
    tgt = spark.createDataFrame([(1, "a"), (2, "b")], "ref int, supplier string")
    d = Domain("d", Side("s", (("id", "INT"),), ("vendor",)), Side("t", (("ref", "INT"),), ("supplier",)))
    s, t = scope.both_sides(src, tgt, d, "vendor", lambda df, c: scope.entity(df, c, "b"))
    assert (s.first()["id"], t.first()["ref"]) == (2, 2) and s.count() == t.count() == 1
    with pytest.raises(ValueError):
        scope.both_sides(src, tgt, d, "supplier", lambda df, c: df)
