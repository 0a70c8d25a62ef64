"""Checks on a domain and its two relations.

`check_domain` and `check_schema` look at names and types only. `key_audit` and
`type_conformance` are Spark jobs over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import DATETIME_FAMILIES, NUMERIC_FAMILIES, Domain, Field, Side
from concord.functions import canon, variance
from concord.operators.hashview import HASH_COLUMNS, column_type, find_hash_column


def compatible(a: Field, b: Field) -> bool:
    """Whether two declared types may be joined."""
    if a.type == b.type:
        return True
    both = {a.family, b.family}
    if None in both:
        return False
    return (
        len(both) == 1
        or both <= NUMERIC_FAMILIES
        or both <= DATETIME_FAMILIES
        or both == {"uuid", "string"}
    )


def check_side(side: Side, label: str) -> list[str]:
    errors = []
    if not (side.table or "").strip():
        errors.append(f"{label}: table is empty")
    for kind, fields in (("id", side.id_fields), ("hash", side.hash_fields)):
        if not fields:
            errors.append(f"{label}: no {kind} fields")
        for i, f in enumerate(fields):
            if not (f.name or "").strip():
                errors.append(f"{label}: {kind} field {i} has no name")
            if f.family is None:
                errors.append(f"{label}: {kind} field {i} has unsupported type {f.type!r}")
    return errors


def check_domain(domain: Domain) -> list[str]:
    """Errors in the declaration itself; empty when it is sound."""
    errors = [] if (domain.name or "").strip() else ["domain name is empty"]
    errors += check_side(domain.source, "source") + check_side(domain.target, "target")
    src, tgt = domain.source, domain.target
    if len(src.hash_fields) != len(tgt.hash_fields):
        errors.append(f"source has {len(src.hash_fields)} hash fields, target has {len(tgt.hash_fields)}")
    if len(src.id_fields) != len(tgt.id_fields):
        errors.append(f"source has {len(src.id_fields)} id fields, target has {len(tgt.id_fields)}")
    else:
        for i, (a, b) in enumerate(domain.id_pairs()):
            if not compatible(a, b):
                errors.append(f"id field {i}: {a.type} and {b.type} cannot be joined")
    return errors


def check_schema(df: DataFrame, side: Side, label: str, use_hash_column: bool = False) -> list[str]:
    """Errors in a relation's columns against its declaration; names are compared ignoring case."""
    if not df.columns:
        return [f"{label} {side.view_name}: relation has no columns"]
    present = {c.lower() for c in df.columns}
    errors = []
    for kind, fields in (("id", side.id_fields), ("hash", side.hash_fields)):
        for i, f in enumerate(fields):
            if f.name.lower() not in present:
                errors.append(f"{label} {side.view_name}: {kind} field {i} {f.name!r} is missing")
                continue
            try:
                canon.physical_family(column_type(df, f.name))
            except TypeError as e:
                errors.append(f"{label} {side.view_name}: {kind} field {i} {f.name!r}: {e}")
    if use_hash_column and find_hash_column(df) is None:
        errors.append(f"{label} {side.view_name}: no hash column (expected one of {', '.join(HASH_COLUMNS)})")
    return errors


def check(source: DataFrame, target: DataFrame, domain: Domain, use_hash_column: bool = False) -> list[str]:
    return (
        check_domain(domain)
        + check_schema(source, domain.source, "source", use_hash_column)
        + check_schema(target, domain.target, "target", use_hash_column)
    )


def require(source: DataFrame, target: DataFrame, domain: Domain, use_hash_column: bool = False) -> None:
    """Raise with every error found, before any data is read."""
    errors = check(source, target, domain, use_hash_column)
    if errors:
        raise ValueError(f"domain {domain.name!r}: " + "; ".join(errors))


def require_all(domains: list[Domain]) -> None:
    """Check several declarations at once; the errors of all are reported together."""
    errors = [f"{d.name!r}: {e}" for d in domains for e in check_domain(d)]
    if errors:
        raise ValueError("; ".join(errors))


def key_audit(df: DataFrame, id_names: list[str]) -> DataFrame:
    """Keys that break the rule of one row per key: repeated ones and those with a NULL part."""
    has_null: Column = F.lit(False)
    for n in id_names:
        has_null = has_null | F.col(n).isNull()
    return (
        df.groupBy(*id_names)
        .agg(F.count("*").alias("row_count"))
        .withColumn("null_key", has_null)
        .where((F.col("row_count") > 1) | F.col("null_key"))
    )


def type_conformance(df: DataFrame, fields: list[Field] | tuple[Field, ...]) -> DataFrame:
    """Per field: values present, and values whose text does not fit the declared type."""
    aggs = []
    for i, f in enumerate(fields):
        c = df[f.name]
        aggs += [F.count(c).alias(f"n_{i}"), F.count_if(c.isNotNull() & ~fits(df, f)).alias(f"bad_{i}")]
    # A single row of counts, turned into one line per field.
    lines = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field_name"),
                F.lit(f.type).alias("declared_type"),
                F.col(f"n_{i}").alias("present"),
                F.col(f"bad_{i}").alias("nonconforming"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return df.agg(*aggs).select(F.inline(lines))


def fits(df: DataFrame, f: Field) -> Column:
    """Whether a column's value fits the declared type; NULL for NULL."""
    c = df[f.name]
    family = f.family
    if family is None:
        raise ValueError(f"field {f.name!r} has unsupported type {f.type!r}")
    if family in ("string", "binary"):
        return F.lit(True)
    text = canon.raw_text(c, column_type(df, f.name))
    if family == "uuid":
        return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    if family == "decimal":
        return _fits_decimal(c, text, column_type(df, f.name), f)
    cast = text.try_cast(SPARK_TYPE[f.type]).isNotNull()
    return text.rlike(variance.NUMBER) & cast if f.is_numeric() else cast


def _fits_decimal(c: Column, text: Column, dtype: T.DataType, f: Field) -> Column:
    """Whether a decimal of the declared precision and scale, else of the column's own, else any of 38 digits,
    holds the value without rounding it."""
    whole_number = text.rlike(canon.PLAIN_NUMBER)
    short = canon.short_number(text)
    if f.precision is not None and isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.try_cast(f"decimal({f.precision},{f.scale or 0})").cast("double") == text.cast("double"), F.lit(False))
    if f.precision is not None:
        kept = text.try_cast(f"decimal({f.precision},{f.scale or 0})").cast("string")
        return whole_number & F.coalesce(canon.short_number(kept) == short, F.lit(False))
    if isinstance(dtype, (T.DecimalType, T.IntegralType)):
        return F.lit(True)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return ~text.isin("NaN", "Infinity", "-Infinity")
    return whole_number & (F.length(F.regexp_replace(short, "[^0-9]", "")) <= 38)


# The Spark type a declared type is checked against.
SPARK_TYPE = {
    "INT": "int",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "SMALLINT": "smallint",
    "FLOAT": "double",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
}
