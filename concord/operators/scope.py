"""Restrict both sides before they are joined.

A filter on the joined key would stay above a full outer join; on the sides it reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import Domain
from concord.operators.hashview import column_type


def _day(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _days(df: DataFrame, column: str, first: str | dt.date, last: str | dt.date) -> Column:
    """From the first day to the end of the last, as plain bounds a parquet or JDBC scan can use."""
    c, kind = df[column], column_type(df, column)
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.between(F.lit(_day(first)), F.lit(_day(last)))
    after = _day(last) + dt.timedelta(days=1)
    return (c >= F.lit(str(_day(first))).cast(kind)) & (c < F.lit(str(after)).cast(kind))


def entity(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one entity."""
    return df.where(df[column] == F.lit(value))


def period(df: DataFrame, column: str, day: str | dt.date) -> DataFrame:
    """Rows of one billing day; a timestamp column is taken for the whole day."""
    return df.where(_days(df, column, day, day))


def date_range(df: DataFrame, column: str, first: str | dt.date, last: str | dt.date) -> DataFrame:
    """Rows from `first` to `last`, both days included."""
    return df.where(_days(df, column, first, last))


def both_sides(
    source: DataFrame,
    target: DataFrame,
    domain: Domain,
    field: str | tuple[str, str],
    restrict: Callable[[DataFrame, str], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Apply a filter to a source field and to the target field it is paired with.

    `field` names a source field, or any column of each side, which need not be compared.
    `restrict` takes a frame and a column name, e.g. `lambda df, c: period(df, c, "2024-01-31")`.
    """
    if not isinstance(field, str):
        return restrict(source, field[0]), restrict(target, field[1])
    for a, b in [*domain.id_pairs(), *domain.field_pairs()]:
        if a.name == field:
            return restrict(source, a.name), restrict(target, b.name)
    raise ValueError(f"{field!r} is not a field of the source")
