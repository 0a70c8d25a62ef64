"""Reader options, connections and file or table input."""

import pytest

from concord import Enrichment, Field, Side
from concord.sources import relations as rel


def test_names():
    side = Side("invoices", schema="finance", view_suffix="_hash")
    assert (side.table_name, side.view_name) == ("finance.invoices", "finance.invoices_hash")
    assert Side("t", view_suffix=None).view_name == "t"
    two = Side("t", (Field("a"), "b"), ("c",))
    assert two.has_composite_id and two.id_names == ["a", "b"] and two.hash_names == ["c"]


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("jdbc:postgresql://h:5432/db", "postgres"),
        ("jdbc:oracle:thin:@//h:1521/x", "oracle"),
        ("jdbc:mysql://h/db", "mysql"),
        ("jdbc:sqlserver://h;databaseName=x", "sqlserver"),
    ],
)
def test_kind_from_url(url, kind):
    assert rel.kind_from_url(url) == kind
    options = rel.jdbc_options(Side("t", schema="s", url=url, username="u", password="p"))
    assert options["driver"] == rel.DRIVERS[kind] and options["dbtable"] == "s.t" and options["password"] == "p"


@pytest.mark.parametrize("url", [None, "", "jdbc:db2://h/x"])
def test_unknown_url(url):
    with pytest.raises(ValueError):
        rel.kind_from_url(url)


def test_kind_names():
    assert rel.kind_from_name("Oracle") == "oracle"
    with pytest.raises(ValueError):
        rel.kind_from_name("db2")
    side = Side("t", kind="ORACLE", url="jdbc:postgresql://h/db", username="u")
    assert rel.jdbc_options(side)["driver"] == rel.DRIVERS["oracle"]


def test_connection_of_the_side_wins():
    default = rel.Connection("jdbc:mysql://g/db", "global", "secret")
    own = Side("t", url="jdbc:oracle:thin:@x", username="me", password="mine")
    assert rel.resolve_connection(own, default).username == "me"
    half = Side("t", url="jdbc:oracle:thin:@x")
    assert not half.has_connection and rel.resolve_connection(half, default) == default
    with pytest.raises(ValueError):
        rel.resolve_connection(half, None)
    assert "mine" not in repr(own)


def test_slices():
    side = Side("t", url="jdbc:mysql://g/db", username="u")
    options = rel.jdbc_options(side, slices=rel.Slices("id", "1", "1000000", 64, 5000))
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "64"
    assert (options["lowerBound"], options["upperBound"], options["fetchsize"]) == ("1", "1000000", "5000")
    assert "password" not in options and "numPartitions" not in rel.jdbc_options(side)


def test_parquet_and_tables(spark, tmp_path):
    spark.range(3).selectExpr("id", "id % 2 AS c").write.parquet(f"{tmp_path}/facts_v.parquet")
    spark.createDataFrame([(0, "even"), (1, "odd")], "c bigint, word string").write.parquet(f"{tmp_path}/words.parquet")
    side = Side("facts", view_suffix="_v", joins=(Enrichment("words", "c", "c"),))
    df = rel.read_parquet(spark, side, str(tmp_path))
    assert sorted((r["id"], r["word"]) for r in df.collect()) == [(0, "even"), (1, "odd"), (2, "even")]
    df.drop("word").createOrReplaceTempView("facts_v")
    spark.read.parquet(f"{tmp_path}/words.parquet").createOrReplaceTempView("words")
    assert rel.read_table(spark, side).count() == 3
