"""A record of one side as a struct: id, hash, side and its fields as a text map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import canon
from concord.operators.hashview import PairColumns


def record_id(keys: list[str]) -> Column:
    """The true key as text."""
    return F.concat_ws(canon.SEPARATOR, *[F.col(k).cast("string") for k in keys])


def record(keys: list[str], pairs: list[PairColumns], side: str) -> Column:
    """NULL where the row is missing on that side."""
    prefix = "src" if side == "source" else "tgt"
    entries = []
    for p in pairs:
        name, dtype = (p.src, p.src_type) if side == "source" else (p.tgt, p.tgt_type)
        label = name.removeprefix(f"{prefix}_")
        entries += [F.lit(label), canon.raw_text(F.col(name), dtype)]
    return F.when(
        F.col(f"{prefix}_present"),
        F.struct(
            record_id(keys).alias("id"),
            F.coalesce(F.col(f"{prefix}_hash"), F.lit("")).alias("record_hash"),
            F.lit(side).alias("side"),
            F.create_map(*entries).alias("fields"),
        ),
    )


def get_field(rec: str, name: str) -> Column:
    return F.try_element_at(F.col(f"{rec}.fields"), F.lit(name))


def has_field(rec: str, name: str) -> Column:
    return F.map_contains_key(F.col(f"{rec}.fields"), name)


def field_names(rec: str) -> Column:
    return F.map_keys(F.col(f"{rec}.fields"))


def with_fields(rec: str, fields: dict[str, str | None]) -> Column:
    """The record with its fields replaced."""
    entries = [F.lit(x).cast("string") for pair in fields.items() for x in pair]
    return F.col(rec).withField("fields", F.create_map(*entries))


def same_record(a: str, b: str) -> Column:
    """Records are equal when id and hash are."""
    return (F.col(f"{a}.id") == F.col(f"{b}.id")) & (F.col(f"{a}.record_hash") == F.col(f"{b}.record_hash"))


def distinct_records(df: DataFrame, rec: str) -> DataFrame:
    """One row per record identity."""
    return (
        df.withColumns({"_id": F.col(f"{rec}.id"), "_hash": F.col(f"{rec}.record_hash")})
        .dropDuplicates(["_id", "_hash"])
        .drop("_id", "_hash")
    )
