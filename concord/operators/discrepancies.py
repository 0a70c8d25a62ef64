"""Filters, pages and projections of a discrepancy frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from concord.functions import verdict


def material(df: DataFrame) -> DataFrame:
    return df.where(F.col("strict_verdict") == verdict.MATERIAL)


def noisy(df: DataFrame) -> DataFrame:
    return df.where(F.col("strict_verdict") == verdict.NOISY)


def of_type(df: DataFrame, discrepancy_type: str) -> DataFrame:
    if discrepancy_type not in verdict.TYPE_DESCRIPTION:
        raise ValueError(f"unknown discrepancy type {discrepancy_type!r}")
    return df.where(F.col("discrepancy_type") == discrepancy_type)


def high_variance(df: DataFrame, above: float = 10.0) -> DataFrame:
    """Rows whose largest variance is above the limit."""
    return df.where(F.col("max_variance") > above)


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("k_") and c[2:].isdigit()]


def page(df: DataFrame, size: int, after: Row | None = None) -> DataFrame:
    """The next `size` lines in key order after the last line of the page before.

    Equal lines are one line with their number of copies, so a key repeated across a page
    border loses nothing. Each page runs the alignment; give both sides a lower bound on the key
    beforehand (`scope`) where that is dear, or store the list (`plans.listing`).
    """
    order = line_order(df)
    if after is not None:
        df = df.where(behind(df, order, after))
    return lines_of(df).orderBy(*order).limit(size)


def line_order(df: DataFrame) -> list[str]:
    return [*keys_of(df), "status", "src_hash", "tgt_hash", "verdict", "strict_verdict"]


def lines_of(df: DataFrame) -> DataFrame:
    """The lines of a discrepancy list: equal ones are one, with their number of copies."""
    return df.groupBy(*line_order(df), "record_id", "discrepancy_type", "details").agg(F.sum("copies").alias("copies"))


def behind(df: DataFrame, order: list[str], after: Row) -> Column:
    """Field by field behind a line, with NULLs first, as ORDER BY does."""
    found, same = F.lit(False), F.lit(True)
    for c in order:
        value = F.lit(after[c]).cast(df.schema[c].dataType)
        larger = F.col(c).isNotNull() if after[c] is None else F.coalesce(F.col(c) > value, F.lit(False))
        found = found | (same & larger)
        same = same & F.col(c).eqNullSafe(value)
    return found


def hashes(df: DataFrame) -> DataFrame:
    """Record id with both hashes."""
    return df.select("record_id", "src_hash", "tgt_hash", "copies")


def by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("discrepancy_type").agg(F.sum("copies").alias("discrepancies"))
