"""Several domains in one pass, audits in parts, and slices by quantile."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import pairs
from concord import Domain, Field, Side, reconcile
from concord.plans import audit, contracts
from concord.plans.many import summaries
from concord.plans.summary import COUNTS, union_summaries
from concord.sources.relations import quantile_bounds, slice_predicates
from helpers import domain, frame
from test_plans import plan

SF_DIR = "/root/testdata/sf0.001"
ROWS = [(1, 10, "a"), (1, 10, "a"), (2, 20, "b"), (None, 5, "n"), (4, None, None), (5, 0, "z"), (6, 7, "x" * 80), (7, 1, "7")]
OTHER = [(1, 10, "a"), (2, 21, "b"), (None, 5, "n"), (4, None, None), (5, 1, "z"), (6, 7, "x" * 79 + "y"), (8, 1, None), (7, 1, "7.001")]


def same(together, apart):
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, union_summaries(apart).select(together.columns).collect()))


@pytest.mark.parametrize("hot_rows", [None, 2, 10_000])
def test_equals_domains_one_by_one(spark, hot_rows):
    both = [[(k, None if a is None else Decimal(a), t) for k, a, t in rows] for rows in (ROWS, OTHER)]
    one = [frame(spark, rows) for rows in both]
    two = [frame(spark, [(k, j, a, t) for k, a, t in rows for j in (1, 2)], keys=2) for rows in both]
    empty = [df.where("false") for df in one]
    times = Side("t", (Field("at", "TIMESTAMP"),), (Field("x", "DOUBLE"), Field("y")))
    moments = [
        spark.createDataFrame([(datetime(2024, 10, 27, 0, 30), x, "1"), (datetime(2024, 10, 27, 1, 30), 0.0, None)], "at timestamp, x double, y string")
        for x in (-0.0, float("nan"))
    ]
    sides = [
        (*one, domain("one")),
        (*one, domain("loose", slo_target=50.0, variance_threshold=10.0)),
        (*two, domain("two", keys=2)),
        (*empty, domain("none")),
        (*moments, Domain("times", times, times)),
    ]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # both moments have the same local text
    try:
        same(summaries(sides, hot_rows=hot_rows), [reconcile(*s, hot_rows=hot_rows).summary for s in sides])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sides_of_several_domains_are_aligned_once(spark):
    def sides(*names):
        return [(pairs.orders(spark, SF_DIR), pairs.orders_copy(spark, SF_DIR), pairs.orders_domain(n, slo_target=50.0 + i)) for i, n in enumerate(names)]

    def scans(found):
        return plan(found).split("== Initial Plan ==")[0].count(") Scan parquet")

    more = scans(summaries(sides("a", "b", "c"), hot_rows=None)) - scans(summaries(sides("a"), hot_rows=None))
    assert more <= 4  # the totals' own scans
    df = frame(spark, [(1, Decimal(1), "a"), (2, Decimal(2), "b")])
    swapped = df.select("id1", F.col("amount").alias("note"), F.col("note").alias("amount"))
    two = [(df, df, domain("one")), (swapped, df, domain("two"))]
    same(summaries(two, hot_rows=None), [reconcile(*s, hot_rows=None).summary for s in two])


def test_fields_are_measured_without_long_generated_code(spark):
    """As columns of their own the fields' steps made methods too long to be compiled; doubles in the counted values were normalised singly."""
    sides = [(pairs.orders(spark, SF_DIR), pairs.orders_copy(spark, SF_DIR), pairs.orders_domain("a"))]
    text = plan(summaries(sides, hot_rows=None))
    assert "normalizenanandzero" not in text and "_type_3" not in text and "_pct_3" not in text


def test_exchanges_do_not_grow_with_domains(spark):
    def exchanges(n):
        sides = [(pairs.orders(spark, SF_DIR), pairs.orders_copy(spark, SF_DIR), pairs.orders_domain(f"d{i}")) for i in range(n)]
        return plan(summaries(sides)).split("== Initial Plan ==")[0].count("\nArguments: hashpartitioning")

    assert exchanges(1) == exchanges(4) > 0


def test_domains_need_names_of_their_own(spark):
    df = frame(spark, [])
    with pytest.raises(ValueError, match="same name"):
        summaries([(df, df, domain("d")), (df, df, domain("d"))])
    with pytest.raises(ValueError, match="no domains"):
        summaries([])
    assert summaries([(df, df, domain("d"))]).select("match_pct", *COUNTS).first() == (100.0, *[0] * len(COUNTS))


def test_audit_of_parts_is_that_of_the_whole(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, str(i) if i % 3 else "x", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, n string, v double")
    fields = [Field("n", "INT"), Field("v", "DOUBLE"), Field("n", "STRING")]
    path = str(tmp_path / "parts")
    half = F.col("v") < 50
    for part in (half, ~half, half):  # one part comes twice
        audit.store_parts(audit.audit_parts(df.where(part), ["id"], fields, half), path)
    stored = spark.read.parquet(path)
    whole = audit.audit_parts(df, ["id"], fields, F.lit("all"))
    assert audit.merged_keys(stored).first() == audit.merged_keys(whole).first() == (100, 20, 7, 73)
    got = {(r.field_name, r.declared_type): (r.present, r.nonconforming, r.quantiles) for r in audit.merged_fields(stored).collect()}
    plain = contracts.type_conformance(df, fields).collect()
    assert {k: v[:2] for k, v in got.items()} == {(r.field_name, r.declared_type): (r.present, r.nonconforming) for r in plain}
    assert got["v", "DOUBLE"][2] == pytest.approx([0.0, 49.0, 99.0], abs=1) and got["n", "STRING"][2] is None
    assert audit.merged_keys(stored.where("false")).first() == (0, 0, 0, 0)


def test_audit_of_many_keys_is_near(spark):
    df = spark.range(300_000).select((F.col("id") % 200_000).alias("id"))
    parts = audit.audit_parts(df, ["id"], [], F.col("id") % 4)
    assert audit.merged_keys(parts).first()["distinct_keys"] == pytest.approx(200_000, rel=0.03)


def test_offenders(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [("c",)] * 5 + [("d",), ("1",), (None,)], "n string")
    got = [(r.value, r.occurrences, r["rank"]) for r in audit.offenders(df, [Field("n", "INT")], 2).collect()]
    assert sorted(got) == [("a", 3, 2), ("c", 5, 1)]


@pytest.mark.parametrize("kind", ["long", "double", "decimal(9,2)", "date", "timestamp"])
def test_slices_hold_every_row_once_and_evenly(spark, kind):
    value = {"date": "date_add(date '2024-01-01', int(v))", "timestamp": "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, v)"}
    skewed = spark.range(1000).selectExpr("id", "pow(id, 3) / 1e5 AS v").selectExpr("id", f"CAST({value.get(kind, 'v')} AS {kind}) AS v")
    df = skewed.unionAll(spark.range(3).selectExpr("-1 - id", f"CAST(NULL AS {kind})"))
    bounds = quantile_bounds(df, "v", 8)
    parts = [[r["id"] for r in df.where(p).collect()] for p in slice_predicates("v", bounds)]
    assert max(Counter(i for p in parts for i in p).values()) == 1 and sum(map(len, parts)) == 1003
    assert max(map(len, parts)) <= (500 if kind in ("long", "date") else 140)


def test_slices_of_one_value_and_none(spark):
    df = spark.range(10).selectExpr("5 AS v")
    assert slice_predicates("v", quantile_bounds(df, "v", 4)) == ["v < 5 OR v IS NULL", "v >= 5"]
    assert slice_predicates("v", quantile_bounds(df.where("false"), "v", 4)) == ["1 = 1"]
    assert slice_predicates("d", [date(2024, 1, 2)])[1] == "d >= DATE '2024-01-02'"
