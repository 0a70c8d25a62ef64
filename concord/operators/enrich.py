"""Join a side with a reference table before it is hashed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from concord.domain import Side


def enrich(
    df: DataFrame, reference: DataFrame, key: str, ref_key: str, how: str = "left", columns: tuple[str, ...] = ()
) -> DataFrame:
    """Add the reference table's columns (all, or the named ones) by one key pair.

    No broadcast is forced: Spark picks it by the reference table's measured size, and splits
    a skewed key of this side otherwise.
    """
    how = how.lower()
    if how not in ("left", "inner"):
        raise ValueError(f"enrichment joins are left or inner, not {how}")
    wanted = [c for c in (columns or reference.columns) if c != ref_key]
    taken = {c.lower() for c in df.columns}
    clash = [c for c in wanted if c.lower() in taken]
    if clash:
        raise ValueError("reference columns already present: " + ", ".join(clash))
    lookup = reference.select(reference[ref_key].alias("_ref_key"), *wanted)
    return df.join(lookup, df[key] == lookup["_ref_key"], how).drop("_ref_key")


def enrich_side(df: DataFrame, side: Side, read: Callable[[str], DataFrame]) -> DataFrame:
    """Apply the side's declared enrichment joins in order; `read` opens a table by name."""
    for e in side.joins:
        df = enrich(df, read(e.table), e.key, e.ref_key, e.how, e.columns)
    return df
