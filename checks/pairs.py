"""Pairs of relations made from the given tables by rule.

The tables hold one copy of everything, so a target is derived from the whole of a table: some
values are changed, and some keys are renumbered, which leaves a row without partner on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.domain import Domain, Field, Side

MONEY = "decimal(19,4)"

ORDER_FIELDS = (
    Field("o_custkey", "BIGINT"),
    Field("price", "DECIMAL"),
    Field("o_orderdate", "TIMESTAMP"),
    Field("o_orderstatus", "STRING"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast(MONEY).alias("price"), "o_orderdate", "o_orderstatus"
    )


TYPED_FIELDS = (
    Field("o_custkey", "BIGINT"),
    Field("amount", "DECIMAL"),
    Field("ratio", "DOUBLE"),
    Field("large", "DOUBLE"),
    Field("placed", "TIMESTAMP"),
    Field("day", "DATE"),
    Field("open", "BOOLEAN"),
    Field("code", "BYTES"),
)


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with a value of every type that databases write in their own way."""
    key = F.col("o_orderkey")
    return orders(spark, sf_dir).select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 11 != 4, F.col("price").cast("decimal(15,2)")).alias("amount"),
        (F.col("price").cast("double") / F.lit(8.0)).alias("ratio"),
        (F.col("price").cast("double") * F.lit(2.0**60)).alias("large"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, (o_orderkey % 1000) / 1000.0)")).alias("placed"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(key % 13 != 5, F.col("o_orderstatus") == "O").alias("open"),
        F.encode("o_orderstatus", "UTF-8").alias("code"),
    )


def changed_price() -> Column:
    rule = F.pmod("o_orderkey", F.lit(20))
    price = F.col("price")
    return (
        F.when(rule == 3, (price * F.lit("1.005").cast("decimal(4,3)")).cast(MONEY))
        .when(rule == 4, (price * F.lit("1.10").cast("decimal(4,3)")).cast(MONEY))
        .when(rule != 5, price)
    )


def orders_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: one in 50 renumbered, one in 20 each with price +0.5 %, +10 %, NULL, or status Z."""
    key = F.col("o_orderkey")
    return orders(spark, sf_dir).select(
        F.when(key % 50 == 9, -1 - key).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        changed_price().alias("price"),
        "o_orderdate",
        F.when(key % 20 == 6, F.lit("Z")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )


def orders_domain(name: str = "orders", **options) -> Domain:
    side = Side("orders", (Field("o_orderkey", "BIGINT"),), ORDER_FIELDS)
    return Domain(name, side, side, **options)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast(MONEY).alias("price"), "l_returnflag"
    )


def lineitems_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items: returns of every 10th part flagged X, lines of every 25th part renumbered."""
    part = F.col("l_partkey")
    line = F.col("l_linenumber")
    return lineitems(spark, sf_dir).select(
        "l_orderkey",
        F.when(part % 25 == 3, line + 100).otherwise(line).alias("l_linenumber"),
        "l_partkey",
        "price",
        F.when(part % 10 == 1, F.lit("X")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )


def lineitems_domain(name: str = "lineitems", **options) -> Domain:
    """Keyed by order and line number, which repeat in the given table."""
    side = Side(
        "lineitem",
        (Field("l_orderkey", "BIGINT"), Field("l_linenumber", "INT")),
        (Field("l_partkey", "BIGINT"), Field("price", "DECIMAL"), Field("l_returnflag", "STRING")),
    )
    return Domain(name, side, side, **options)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def customers_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers under other names and types: balances of one nation +10 %, segments in lower case."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("cust_no"),
        F.col("c_name").alias("full_name"),
        F.col("c_nationkey").cast("decimal(10,0)").alias("nation"),
        F.when(F.col("c_nationkey") == 7, F.col("c_acctbal") * 1.1)
        .otherwise(F.col("c_acctbal"))
        .cast(MONEY)
        .alias("balance"),
        F.lower("c_mktsegment").alias("segment"),
    )


def customers_domain(name: str = "customers", **options) -> Domain:
    source = Side(
        "customer",
        (Field("c_custkey", "BIGINT"),),
        (Field("c_name"), Field("c_nationkey", "INT"), Field("c_acctbal", "DOUBLE"), Field("c_mktsegment")),
    )
    target = Side(
        "customer",
        (Field("cust_no", "BIGINT"),),
        (Field("full_name"), Field("nation", "NUMERIC"), Field("balance", "DECIMAL"), Field("segment")),
    )
    return Domain(name, source, target, **options)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def documents_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: German texts get a closing line, French lengths are dropped."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("lang") == "de", F.concat("text", F.lit("\n--"))).otherwise(F.col("text")).alias("text"),
        "lang",
        F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n_chars"),
    )


def documents_domain(name: str = "documents", **options) -> Domain:
    side = Side(
        "documents", (Field("doc_id", "BIGINT"),), (Field("text"), Field("lang"), Field("n_chars", "BIGINT"))
    )
    return Domain(name, side, side, **options)
