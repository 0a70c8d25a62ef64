"""Checks on declarations, schemas, keys and values."""

from decimal import Decimal

import pytest

from concord import Domain, Field, Side, reconcile
from concord.plans import contracts
from helpers import domain, frame


def sides(src_ids, tgt_ids, src_fields=("a",), tgt_fields=("a",)):
    return Domain("d", Side("s", src_ids, src_fields), Side("t", tgt_ids, tgt_fields))


@pytest.mark.parametrize(
    ("a", "b", "ok"),
    [
        ("STRING", "VARCHAR", True), ("INT", "BIGINT", True), ("INT", "DECIMAL", True), ("FLOAT", "NUMERIC", True),
        ("DATE", "TIMESTAMP", True), ("UUID", "STRING", True), ("CHAR", "UUIDV4", True), ("UUID", "UUIDV4", True),
        ("STRING", "INT", False), ("DATE", "STRING", False), ("BOOLEAN", "INT", False), ("BOOLEAN", "BOOL", True),
        ("UUID", "INT", False), ("weird", "STRING", False), ("text", "CHAR", True),
    ],
)
def test_compatible_types(a, b, ok):
    assert contracts.compatible(Field("x", a), Field("y", b)) is ok


def test_declaration_errors():
    good = sides((("id", "INT"),), (("id", "BIGINT"),))
    assert contracts.check_domain(good) == []
    bad = Domain(" ", Side("", (), ()), Side("t", (("id", "blob"), ("", "INT")), ("a", "b")))
    errors = "; ".join(contracts.check_domain(bad))
    for part in (
        "name is empty", "source: table is empty", "source: no id fields", "source: no hash fields",
        "unsupported type 'BLOB'", "id field 1 has no name", "0 hash fields, target has 2", "0 id fields, target has 2",
    ):
        assert part in errors
    assert "INT and STRING cannot be joined" in contracts.check_domain(sides((("id", "INT"),), (("id", "STRING"),)))[0]
    with pytest.raises(ValueError, match="'d'.*cannot be joined"):
        contracts.require_all([good, sides((("id", "INT"),), (("id", "DATE"),))])


@pytest.mark.parametrize("options", [{"slo_target": 101}, {"slo_target": -1}, {"variance_threshold": -0.1}, {"algorithm": "crc"}])
def test_ranges(options):
    with pytest.raises(ValueError):
        domain(**options)


def test_schema_errors(spark):
    df = spark.createDataFrame([(1, "x")], "ID1 bigint, NOTE string")
    side = domain().source
    errors = contracts.check_schema(df, side, "source", use_hash_column=True)
    assert len(errors) == 2 and "'amount' is missing" in errors[0] and "no hash column" in errors[1]
    for name in ("record_hash", "_RECORD_HASH", "Hash"):
        full = spark.createDataFrame([(1, "x", Decimal(1), "h")], f"ID1 bigint, NOTE string, Amount decimal(5,2), {name} string")
        assert contracts.check_schema(full, side, "source", use_hash_column=True) == []
    nested = spark.createDataFrame([(1, Decimal(1), ["x"])], "id1 bigint, amount decimal(5,2), note array<string>")
    assert "cannot be compared" in contracts.check_schema(nested, side, "source")[0]


def test_reconcile_fails_before_reading(spark):
    ok = frame(spark, [(1, Decimal(1), "a")])
    with pytest.raises(ValueError, match="'amount' is missing"):
        reconcile(ok.drop("amount"), ok, domain())
    with pytest.raises(ValueError, match="no hash column"):
        reconcile(ok, ok, domain(), use_hash_column=True)


def test_key_audit(spark):
    df = frame(spark, [(1, 1, Decimal(1), "a"), (1, 1, Decimal(2), "b"), (1, 2, Decimal(1), "a"), (2, None, None, None)], keys=2)
    rows = {(r["id1"], r["id2"]): (r["row_count"], r["null_key"]) for r in contracts.key_audit(df, ["id1", "id2"]).collect()}
    assert rows == {(1, 1): (2, False), (2, None): (1, True)}


def test_decimals_that_would_be_rounded_do_not_fit(spark):
    df = spark.createDataFrame(
        [("1.23456", Decimal(10**19), 0.1), ("1.2300", Decimal(5), 1e-9), ("1e5", Decimal(5), float("inf")), ("x", None, None)],
        "t string, big decimal(38,0), d double",
    )
    fields = [
        Field("t", "DECIMAL"), Field("t", "DECIMAL", precision=10, scale=2), Field("big", "DECIMAL"),
        Field("big", "NUMERIC", precision=9), Field("d", "DECIMAL"), Field("d", "DECIMAL", precision=9, scale=2),
    ]
    assert [r["nonconforming"] for r in contracts.type_conformance(df, fields).collect()] == [2, 3, 0, 1, 1, 2]


def test_type_conformance(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "550e8400-e29b-41d4-a716-446655440000", "true"), ("x", "soon", "nope", "maybe"), (None,) * 4],
        "n string, d string, u string, b string",
    )
    fields = [Field("n", "SMALLINT"), Field("d", "DATE"), Field("u", "UUID"), Field("b", "BOOL"), Field("n", "STRING")]
    rows = [(r["field_name"], r["present"], r["nonconforming"]) for r in contracts.type_conformance(df, fields).collect()]
    assert rows == [("n", 2, 1), ("d", 2, 1), ("u", 2, 1), ("b", 2, 1), ("n", 2, 0)]
    with pytest.raises(ValueError):
        contracts.type_conformance(df, [Field("n", "BLOB")])
