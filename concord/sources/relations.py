"""Open a side: JDBC, parquet folder or catalog table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.domain import Side
from concord.operators.enrich import enrich_side

# Source kinds and their JDBC driver classes.
DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "oracle": "oracle.jdbc.driver.OracleDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
# The part of a JDBC url that names the kind.
URL_MARKS = {
    ":postgresql:": "postgres",
    ":oracle:": "oracle",
    ":mysql:": "mysql",
    ":sqlserver:": "sqlserver",
}


@dataclass(frozen=True)
class Connection:
    """Default connection, for sides that do not carry their own."""

    url: str
    username: str
    password: str | None = None


@dataclass(frozen=True)
class Slices:
    """How a JDBC table is read in parallel: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    count: int
    fetch_size: int = 10_000


def kind_from_name(name: str) -> str:
    kind = name.lower()
    if kind not in DRIVERS:
        raise ValueError(f"unknown source kind {name!r}")
    return kind


def kind_from_url(url: str | None) -> str:
    if not url:
        raise ValueError("JDBC url is empty")
    for mark, kind in URL_MARKS.items():
        if mark in url:
            return kind
    raise ValueError(f"cannot tell the source kind from url {url!r}")


def resolve_connection(side: Side, default: Connection | None) -> Connection:
    """The side's own connection, or the default one."""
    if side.has_connection:
        return Connection(side.url, side.username, side.password)
    if default is None:
        raise ValueError(f"no connection for {side.view_name}")
    return default


def jdbc_options(side: Side, default: Connection | None = None, slices: Slices | None = None) -> dict[str, str]:
    """Reader options for a side; an explicit kind wins over the url."""
    c = resolve_connection(side, default)
    kind = kind_from_name(side.kind) if side.kind else kind_from_url(c.url)
    options = {"url": c.url, "user": c.username, "dbtable": side.view_name, "driver": DRIVERS[kind]}
    if c.password is not None:
        options["password"] = c.password
    if slices is not None:
        options |= {
            "partitionColumn": slices.column,
            "lowerBound": str(slices.lower),
            "upperBound": str(slices.upper),
            "numPartitions": str(slices.count),
            "fetchsize": str(slices.fetch_size),
        }
    return options


def quantile_bounds(df: DataFrame, column: str, count: int, accuracy: int = 100_000) -> list:
    """Values that cut a column into `count` slices of about the same number of rows. `df` may be an earlier copy of the table or a
    read of that column alone; the driver gets `count` - 1 values at most, as a value that fills several slices is one bound."""
    if count < 1:
        raise ValueError("count must be positive")
    shares = [i / count for i in range(1, count)]
    if not shares:
        return []
    cut = df.agg(F.percentile_approx(column, shares, accuracy).alias("cut")).first()["cut"]
    return list(dict.fromkeys(cut or []))


def slice_predicates(column: str, bounds: Sequence) -> list[str]:
    """Conditions that put every row into exactly one slice: NULLs into the first, the bounds into the slice that they begin."""
    texts = [_literal(b) for b in bounds]
    if not texts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(texts, texts[1:])]
    return [f"{column} < {texts[0]} OR {column} IS NULL", *inner, f"{column} >= {texts[-1]}"]


def _literal(value) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    return str(value)


def read_jdbc(
    spark: SparkSession, side: Side, default: Connection | None = None, slices: Slices | Sequence[str] | None = None
) -> DataFrame:
    """A table or view over JDBC, enriched as the side declares.

    Without slices it arrives in one partition, so give them for large tables: ranges of equal width, or conditions as
    `slice_predicates` makes them, one partition each.
    """
    def read(table: str) -> DataFrame:
        other = replace(side, table=table, view_suffix="")
        return spark.read.format("jdbc").options(**jdbc_options(other, default)).load()

    if slices is None or isinstance(slices, Slices):
        df = spark.read.format("jdbc").options(**jdbc_options(side, default, slices)).load()
    else:
        options = jdbc_options(side, default)
        url, table = options.pop("url"), options.pop("dbtable")
        df = spark.read.jdbc(url, table, predicates=list(slices), properties=options)
    return enrich_side(df, side, read)


def read_parquet(spark: SparkSession, side: Side, folder: str) -> DataFrame:
    """`folder/table[suffix].parquet`, enriched as the side declares."""
    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{table}.parquet")

    return enrich_side(read(side.table + side.view_suffix), side, read)


def read_table(spark: SparkSession, side: Side) -> DataFrame:
    """A catalog table or view, enriched as the side declares."""
    return enrich_side(spark.table(side.view_name), side, spark.table)
