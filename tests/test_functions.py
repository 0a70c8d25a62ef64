"""Text forms, hashes, variances and verdicts, case by case."""

import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord import Domain, Field, Side, hash_view, reconcile
from concord.functions import canon, variance, verdict
from helpers import domain, frame

DEC = T.DecimalType(19, 4)
NTZ = T.TimestampNTZType()


def one(spark, value, dtype):
    return spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))


@pytest.mark.parametrize(
    ("value", "dtype", "declared", "options", "expected"),
    [
        (5, T.IntegerType(), "INT", {}, "5"),
        (Decimal("12.5"), DEC, "DECIMAL", {}, "12.5000"),
        (Decimal("12.5"), DEC, "DECIMAL", {"strip_zeros": True}, "12.5"),
        (Decimal("1200"), DEC, "DECIMAL", {"strip_zeros": True}, "1200"),
        (Decimal("0"), DEC, "DECIMAL", {"strip_zeros": True}, "0"),
        (Decimal("-0.0500"), DEC, "DECIMAL", {"strip_zeros": True}, "-0.05"),
        (Decimal("0.5"), DEC, "DECIMAL", {"profile": "oracle"}, ".5"),
        (Decimal("-0.25"), DEC, "DECIMAL", {"profile": "oracle"}, "-.25"),
        (Decimal("1.00000001"), T.DecimalType(20, 8), "DECIMAL", {}, "1.00000001"),
        (Decimal("1.9"), T.DecimalType(10, 1), "INTEGER", {}, "1.9"),
        (0.00001, T.DoubleType(), "DOUBLE", {}, "1.0E-5"),
        (-0.0, T.DoubleType(), "DOUBLE", {}, "0.0"),
        ("0.00001", T.StringType(), "DECIMAL", {}, "0.00001"),
        ("+012.50", T.StringType(), "DECIMAL", {}, "12.5"),
        ("-.50", T.StringType(), "DECIMAL", {}, "-0.5"),
        ("-0.0", T.StringType(), "INT", {}, "0"),
        ("1e5", T.StringType(), "INT", {}, "1e5"),
        (float("nan"), T.DoubleType(), "DOUBLE", {}, "NaN"),
        (1e300, T.DoubleType(), "DOUBLE", {}, "1.0E300"),
        ("12.5", T.StringType(), "DECIMAL", {}, "12.5"),
        ("n/a", T.StringType(), "DECIMAL", {}, "n/a"),
        (date(2024, 1, 15), T.DateType(), "DATE", {}, "2024-01-15"),
        (True, T.BooleanType(), "BOOLEAN", {"profile": "mysql"}, "1"),
        (False, T.BooleanType(), "BOOLEAN", {"profile": "sqlserver"}, "0"),
        (True, T.BooleanType(), "BOOLEAN", {"profile": "postgres"}, "true"),
        ("maybe", T.StringType(), "BOOLEAN", {"profile": "mysql"}, "maybe"),
        (Decimal("0.5"), DEC, "DECIMAL", {"profile": "mysql"}, "0.5000"),
        (Decimal("-12.25"), DEC, "DECIMAL", {"profile": "sqlserver"}, "-12.2500"),
        ("no number", T.StringType(), "DECIMAL", {"profile": "sqlserver"}, "no number"),
        (100.0, T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "100"),
        (0.1, T.DoubleType(), "DOUBLE", {"profile": "mysql"}, "0.1"),
        (-0.0, T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "0"),
        (12345678.5, T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "12345678.5"),
        (1e15, T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "1e+15"),
        (1e15, T.DoubleType(), "DOUBLE", {"profile": "mysql"}, "1e15"),
        (-2.5e-7, T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "-2.5e-07"),
        (-2.5e-7, T.DoubleType(), "DOUBLE", {"profile": "mysql"}, "-0.00000025"),
        (float("inf"), T.DoubleType(), "DOUBLE", {"profile": "postgres"}, "Infinity"),
        (float("nan"), T.DoubleType(), "DOUBLE", {"profile": "mysql"}, "NaN"),
        (b"\xab", T.BinaryType(), "BYTES", {"profile": "postgres"}, "\\xab"),
        (b"\xab", T.BinaryType(), "BYTES", {"profile": "sqlserver"}, "0xAB"),
        (b"\xab", T.BinaryType(), "BYTES", {"profile": "mysql"}, "AB"),
        (datetime(2024, 1, 15, 8, 30, 59, 500000), T.TimestampNTZType(), "TIMESTAMP", {"profile": "mysql"}, "2024-01-15 08:31:00"),
        (datetime(2024, 1, 15, 8, 30, 59, 500000), T.TimestampNTZType(), "TIMESTAMP", {"profile": "sqlserver"}, "2024-01-15 08:30:59.5000000"),
        (datetime(2024, 1, 15, 8, 30, 59, 500000), T.TimestampNTZType(), "TIMESTAMP", {"profile": "postgres"}, "2024-01-15 08:30:59.5"),
        (date(2024, 1, 15), T.DateType(), "DATE", {"profile": "oracle"}, "2024-01-15 00:00:00"),
        (datetime(2024, 1, 15, 9, 30), NTZ, "TIMESTAMP", {}, "2024-01-15 09:30:00"),
        (datetime(2024, 1, 15, 9, 30), NTZ, "DATE", {}, "2024-01-15"),
        ("550E8400-E29B", T.StringType(), "UUID", {}, "550e8400-e29b"),
        (True, T.BooleanType(), "BOOLEAN", {}, "true"),
        (bytearray(b"\x01\xff"), T.BinaryType(), "BYTES", {}, "01FF"),
        (" Mixed ", T.StringType(), "STRING", {}, " Mixed "),
    ],
)
def test_declared_text(spark, value, dtype, declared, options, expected):
    df = one(spark, value, dtype)
    assert df.select(canon.declared_text(df["v"], dtype, Field("v", declared), **options)).first()[0] == expected


def pair_texts(spark, a, a_type, b, b_type, a_decl="STRING", b_decl="STRING"):
    df = spark.createDataFrame([(a, b)], T.StructType([T.StructField("a", a_type), T.StructField("b", b_type)]))
    ta, tb = canon.paired_text(df["a"], a_type, Field("a", a_decl), df["b"], b_type, Field("b", b_decl))
    return tuple(df.select(ta, tb).first())


@pytest.mark.parametrize(
    ("args", "equal"),
    [
        ((5, T.IntegerType(), 5, T.LongType()), True),
        ((5, T.IntegerType(), Decimal("5.00"), T.DecimalType(10, 2)), True),
        ((Decimal("1500.5"), T.DecimalType(12, 1), Decimal("1500.500"), T.DecimalType(14, 3)), True),
        ((Decimal("1500.5"), DEC, 1500.5, T.DoubleType()), True),
        ((date(2024, 1, 15), T.DateType(), datetime(2024, 1, 15, 23, 59), NTZ), True),
        ((datetime(2024, 1, 15), NTZ, datetime(2024, 1, 15, 0, 0, 1), NTZ), False),
        (("ABC-1", T.StringType(), "abc-1", T.StringType(), "UUID", "STRING"), True),
        (("ABC-1", T.StringType(), "abc-1", T.StringType()), False),
        (("5", T.StringType(), 5, T.LongType()), True),
        (("05", T.StringType(), 5, T.LongType()), False),
        ((bytearray(b"a"), T.BinaryType(), bytearray(b"a"), T.BinaryType()), True),
        ((True, T.BooleanType(), "true", T.StringType()), True),
        ((1e300, T.DoubleType(), 2e300, T.DoubleType()), False),
        ((0.00001, T.DoubleType(), 0.00004, T.DoubleType()), False),
        ((-0.0, T.DoubleType(), 0.0, T.DoubleType()), True),
        (("0.00001", T.StringType(), "0.00004", T.StringType(), "DECIMAL", "DECIMAL"), False),
        (("1.50", T.StringType(), "01.5", T.StringType(), "DECIMAL", "DECIMAL"), True),
        ((Decimal("0.00001"), T.DecimalType(20, 8), 0.00004, T.DoubleType()), False),
        ((Decimal("0.00004"), T.DecimalType(20, 8), 0.00004, T.DoubleType()), True),
        ((Decimal("1.00000001"), T.DecimalType(20, 8), Decimal("1.00000002"), T.DecimalType(20, 8)), False),
        ((Decimal(10**19), T.DecimalType(38, 0), 1e19, T.DoubleType()), True),
        (("0.1", T.StringType(), 0.1, T.DoubleType(), "DOUBLE", "DOUBLE"), True),
        (("0.10000000000000000001", T.StringType(), 0.1, T.DoubleType(), "DOUBLE", "DOUBLE"), False),
        ((True, T.BooleanType(), Decimal(1), T.DecimalType(1, 0), "BOOLEAN", "BOOLEAN"), True),
        ((True, T.BooleanType(), 2, T.IntegerType(), "BOOLEAN", "BOOLEAN"), False),
        ((False, T.BooleanType(), 0, T.IntegerType(), "BOOLEAN", "BOOLEAN"), True),
    ],
)
def test_paired_text(spark, args, equal):
    a, b = pair_texts(spark, *args)
    assert (a == b) is equal


def test_rounding_is_asked_for(spark):
    df = spark.createDataFrame([(0.12345, Decimal("0.1235"))], "a double, b decimal(10,4)")
    types = {f.name: f.dataType for f in df.schema}
    for digits, equal in ((None, False), (4, True), (2, True), (3, False), (5, False)):
        a, b = canon.paired_text(df["a"], types["a"], Field("a", "DOUBLE", digits), df["b"], types["b"], Field("b", "DECIMAL"))
        row = df.select(a.alias("a"), b.alias("b")).first()
        assert (row["a"] == row["b"]) is equal


@pytest.mark.parametrize(
    ("a_type", "a", "b_type", "b", "pairs"),
    [
        ("decimal(10,5)", ["1.00001", "1.00002"], "double", [1.00001, 1.00002], 2),
        ("double", [1e36], "decimal(38,0)", [10**36], 1),
        ("decimal(38,0)", [10**37, 10**37 + 1], "decimal(38,10)", ["5", "6"], 0),
        ("decimal(38,0)", [12], "decimal(38,10)", ["12"], 1),
        ("bigint", [5], "decimal(12,2)", ["5.00"], 1),
        ("float", [0.5], "double", [0.5], 1),
    ],
)
def test_number_keys(spark, a_type, a, b_type, b, pairs):
    """No two keys of a side become one, and none becomes NULL."""

    def side(kind, values):
        rows = [(Decimal(v) if "decimal" in kind else v, str(v)) for v in values]
        return spark.createDataFrame(rows, f"k {kind}, v string")

    key = Side("t", (Field("k", "NUMERIC"),), (Field("v"),))
    rows = reconcile(side(a_type, a), side(b_type, b), Domain("keys", key, key)).aligned.collect()
    assert sum(r["src_present"] and r["tgt_present"] for r in rows) == pairs
    assert all(r["k_1"] is not None for r in rows) and len(rows) == len(a) + len(b) - pairs


def test_long_digit_runs_take_linear_time(spark):
    import time

    df = spark.createDataFrame([("1" * 1_000_000 + "x",), ("0x" + "f" * 1_000_000,), ("1e" + "5" * 1_000_000 + "x",)], "t string")
    df.select(variance.text_number(F.lit("1"))).collect()
    start = time.perf_counter()
    assert [r[0] for r in df.select(variance.text_number(F.col("t"))).collect()] == [None] * 3
    assert time.perf_counter() - start < 10


def test_record_hash_format(spark):
    side = Side("t", (Field("id", "INT"),), (Field("name"), Field("amount", "DECIMAL"), Field("day", "DATE")))
    df = spark.createDataFrame(
        [(1, "Acme", Decimal("1500.50"), date(2024, 1, 15)), (2, None, None, None)],
        "id int, name string, amount decimal(15,2), day date",
    )
    got = {r["id"]: r["record_hash"] for r in hash_view(df, side).collect()}
    assert got[1] == hashlib.md5(b"Acme|1500.50|2024-01-15").hexdigest()
    assert got[2] == hashlib.md5(b"NULL|NULL|NULL").hexdigest()
    sha = {r["id"]: r["record_hash"] for r in hash_view(df, side, algorithm="sha256").collect()}
    assert sha[1] == hashlib.sha256(b"Acme|1500.50|2024-01-15").hexdigest()
    with pytest.raises(ValueError):
        hash_view(df, Side("t", (), (Field("name"),)))


def verdict_of(spark, a, b, dtype="string", **options):
    """The only variance of a mismatching pair; a second, always different text forces the mismatch."""
    side = Side("t", (Field("id", "INT"),), (Field("v"), Field("w")))
    schema = f"id int, v {dtype}, w string"
    r = reconcile(
        spark.createDataFrame([(1, a, "p")], schema),
        spark.createDataFrame([(1, b, "q")], schema),
        Domain("v", side, side, **options),
        hot_rows=None,
    )
    return r.discrepancies.first()


@pytest.mark.parametrize(
    ("a", "b", "kind", "pct", "over"),
    [
        ("1000.0", "1000.50", "NUMERIC", 0.05, False),
        ("1000.0", "950.0", "NUMERIC", 5.0, True),
        ("1000.0", "990.0", "NUMERIC", 1.0, False),
        ("-500.0", "-450.0", "NUMERIC", 10.0, True),
        ("100.0", "0.0", "NUMERIC", 100.0, True),
        (None, "some_value", "NULL_MISMATCH", 100.0, True),
        ("Invoice ABC", "Invoice ABC", "EXACT_MATCH", 0.0, False),
        ("2000.0", "1800.0", "NUMERIC", 10.0, True),
        (None, None, "EXACT_MATCH", 0.0, False),
        ("abc", "abd", "TEXT", None, False),
        ("0", "5", "NUMERIC", 100.0, True),
        ("0", "0.0", "NUMERIC", 0.0, False),
        ("-0.0", "0", "NUMERIC", 0.0, False),
        ("1500.00", "1500.0", "NUMERIC", 0.0, False),
        ("1e3", "1000", "NUMERIC", 0.0, False),
        ("1f", "1", "NUMERIC", 0.0, False),
        ("1,000", "1000", "TEXT", None, False),
        ("", "0", "TEXT", None, False),
    ],
)
def test_variance_cases(spark, a, b, kind, pct, over):
    row = verdict_of(spark, a, b)
    v = row["variances"][0]
    assert (v["field_name"], v["source_value"], v["target_value"]) == ("v", a, b)
    assert v["variance_type"] == kind
    assert v["variance_pct"] == (pytest.approx(pct) if pct is not None else None)
    assert row["excessive_fields"] == int(over)
    assert row["strict_verdict"] == ("MATERIAL" if over else "NOISY")


def test_number_pattern_lets_every_number_through(spark):
    """The pattern spares failing casts, and tells NaN and Infinity, written so, from other words."""
    texts = [
        "1", "+1", "-1.5", "1.", ".5", ".", "", " ", "1e3", "1E-3", "1e", "1f", "1.0d", "1L", "0x1p3", "0x1.8P1", "0x10",
        "0x.8p0f", "NaN", "-NaN", "Infinity", "-Infinity", "infinit", " 1 ", "\t2\n", "1 2", "1,000",
        "12 Main St", "abc", "1_000", "٣", "--1", "+-1", "1e3e3", "1..2", "true", "2024-01-01",
    ]
    words = ["nan", "inf", "-INF", "+infinity", "INFINITY"]
    df = spark.createDataFrame([(t,) for t in texts + words], "t string")
    rows = df.select("t", variance.text_number(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b")).collect()
    assert [(r["t"], str(r["a"])) for r in rows if r["t"] in texts] == [(r["t"], str(r["b"])) for r in rows if r["t"] in texts]
    assert sum(r["a"] is not None for r in rows) >= 18
    assert all(r["a"] is None for r in rows if r["t"] in words)


@pytest.mark.parametrize("word", ["INF", "nan"])
def test_other_spellings_are_text(spark, word):
    row = verdict_of(spark, "12", word)
    assert (row["variances"][0]["variance_type"], row["variances"][0]["variance_pct"], row["strict_verdict"]) == ("TEXT", None, "NOISY")


def test_nan_does_not_exceed(spark):
    row = verdict_of(spark, "NaN", "5")
    assert row["variances"][0]["variance_type"] == "NUMERIC"
    assert row["variances"][0]["variance_pct"] != row["variances"][0]["variance_pct"]
    assert (row["excessive_fields"], row["verdict"], row["strict_verdict"]) == (0, "NOISY", "NOISY")


@pytest.mark.parametrize(("pct", "over"), [(0.99, False), (0.999, False), (1.0, False), (1.001, True), (1.01, True)])
def test_threshold_is_strict(spark, pct, over):
    df = spark.createDataFrame([(pct,)], "p double")
    assert df.select(F.expr(variance.exceeds("p", 1.0))).first()[0] is over


def test_double_texts_keep_their_sign(spark):
    row = verdict_of(spark, -0.0, 0.0, "double")
    assert row["variances"][0]["variance_type"] == "NUMERIC"


def test_dates_and_flags_are_not_numbers(spark):
    assert verdict_of(spark, date(2024, 1, 1), date(2024, 1, 2), "date")["variances"][0]["variance_type"] == "TEXT"
    assert verdict_of(spark, True, False, "boolean")["variances"][0]["variance_type"] == "TEXT"
    assert verdict_of(spark, bytearray(b"1"), bytearray(b"2"), "binary")["variances"][0]["variance_type"] == "TEXT"


def test_slo_and_threshold_decide_the_verdict(spark):
    over = verdict_of(spark, "100", "110")
    assert (over["matching_fields"], over["total_fields"], over["field_match_pct"]) == (1, 2, 50.0)
    assert (over["verdict"], over["strict_verdict"]) == ("MATERIAL", "MATERIAL")
    loose = verdict_of(spark, "100", "110", slo_target=50.0)
    assert (loose["verdict"], loose["strict_verdict"]) == ("NOISY", "MATERIAL")
    tight = verdict_of(spark, "1000", "1005", variance_threshold=0.4)
    assert (tight["verdict"], tight["strict_verdict"]) == ("MATERIAL", "NOISY")


def test_text_only_differences_are_noisy(spark):
    assert verdict_of(spark, "abc", "xyz")["verdict"] == "NOISY"


def test_missing_hashes_on_both_sides(spark):
    schema = "id1 bigint, amount decimal(15,2), note string, hash string"
    src = spark.createDataFrame([(1, Decimal(1), "a", None), (2, Decimal(1), "a", None)], schema)
    tgt = spark.createDataFrame([(1, Decimal(1), "a", None), (2, Decimal(9), "a", "h")], schema)
    rows = {r["k_1"]: r for r in reconcile(src, tgt, domain(), use_hash_column=True).judged.collect()}
    assert (rows[1]["status"], rows[1]["verdict"], rows[1]["strict_verdict"]) == ("MISMATCH", "NOISY", "PRISTINE")
    assert (rows[2]["status"], rows[2]["verdict"], rows[2]["strict_verdict"]) == ("MISMATCH", "MATERIAL", "MATERIAL")


def test_same_field_listed_twice(spark):
    side = Side("t", (Field("id1", "BIGINT"),), (Field("note"), Field("note"), Field("amount", "DECIMAL")))
    rows = [(1, Decimal(1), "a")]
    r = reconcile(frame(spark, rows), frame(spark, rows), Domain("twice", side, side))
    assert r.aligned.first()["status"] == "MATCH"
    assert {"src_1_note", "src_2_note"} <= set(r.aligned.columns)


@pytest.mark.parametrize(
    ("a", "a_schema", "a_type", "b", "b_schema", "b_type", "status"),
    [
        (7, "bigint", "BIGINT", 7, "int", "INT", "MATCH"),
        ("7", "string", "STRING", 7, "bigint", "STRING", "MATCH"),
        ("x7", "string", "STRING", 7, "bigint", "STRING", "SOURCE_ONLY"),
        (Decimal("7.00"), "decimal(10,2)", "DECIMAL", 7, "bigint", "BIGINT", "MATCH"),
        ("AB-1", "string", "STRING", "ab-1", "string", "UUID", "MATCH"),
        ("AB-1", "string", "STRING", "ab-1", "string", "STRING", "SOURCE_ONLY"),
        (date(2024, 1, 15), "date", "DATE", datetime(2024, 1, 15, 8), "timestamp_ntz", "TIMESTAMP", "MATCH"),
        (7.5, "double", "DOUBLE", 7.5, "double", "DOUBLE", "MATCH"),
    ],
)
def test_key_types(spark, a, a_schema, a_type, b, b_schema, b_type, status):
    src = spark.createDataFrame([(a, "n")], f"id {a_schema}, note string")
    tgt = spark.createDataFrame([(b, "n")], f"ref {b_schema}, note string")
    d = Domain("keys", Side("s", (("id", a_type),), ("note",)), Side("t", (("ref", b_type),), ("note",)))
    r = reconcile(src, tgt, d, hot_rows=None)
    assert status in {row["status"] for row in r.aligned.collect()}


def test_field_predicates():
    assert Field("a", None).type == "STRING" and Field("a", "varchar").is_string()
    assert Field("a", "TEXT").is_string() and Field("a", "uuidv4").is_uuid()
    assert Field("a", "int").is_integer() and Field("a", "float").is_numeric()
    assert not Field("a", "float").is_integer() and Field("a", "datetime").is_datetime()
    assert Field("a", "interval").family is None


def test_lookup_texts(spark):
    df = spark.createDataFrame([Row(v="NOISY"), Row(v="PRISTINE"), Row(v="MATERIAL"), Row(v="other")])
    texts = [r[0] for r in df.select(verdict.lookup(F.col("v"), verdict.VERDICT_DESCRIPTION)).collect()]
    assert texts[3] is None and all(texts[:3])


def test_decimals_wider_than_the_pair_type(spark):
    wide = T.DecimalType(38, 0)
    deep = T.DecimalType(38, 18)
    a, b = pair_texts(spark, Decimal("9" * 38), wide, Decimal("1.5"), deep)
    assert a == "9" * 38 and b.startswith("1.5")
