"""Audits that cost what is new: a table is audited part by part, the parts are stored and merged when read.

A part is whatever rows come together, such as a day or a file. Counts add up; keys are kept in a theta sketch and numeric values
in a KLL sketch, both mergeable and of a bounded size, so that an audit of all parts reads the parts and not the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.domain import Field
from concord.functions import canon, variance
from concord.operators.align import has_null_key
from concord.operators.hashview import column_type
from concord.plans.contracts import fits

#: Entries of a key sketch (log 2) and size of a value sketch.
KEY_ENTRIES = 16
VALUE_SIZE = 400


def audit_parts(df: DataFrame, id_names: Sequence[str], fields: Sequence[Field], part: Column) -> DataFrame:
    """One row per part: rows, rows with a NULL key part, a sketch of the other keys, and per field what is present, what does
    not fit the declared type, and a sketch of the numbers. Counted within each task first; only parts are shuffled."""
    null_key = has_null_key(list(id_names))
    names = [f"f_{i}" for i in range(len(fields))]
    numbers = {
        f"x_{n}": variance.as_number(df[f.name], column_type(df, f.name)) if f.is_numeric() else F.lit(None).cast("double")
        for n, f in zip(names, fields)
    }
    rows = df.select(
        part.cast("string").alias("part"),
        null_key.alias("null_key"),
        F.when(~null_key, F.xxhash64(*id_names)).alias("key"),
        *[df[f.name].isNotNull().alias(f"has_{n}") for n, f in zip(names, fields)],
        *[(df[f.name].isNotNull() & ~fits(df, f)).alias(f"bad_{n}") for n, f in zip(names, fields)],
        *[F.when(~F.isnan(x), x).alias(c) for c, x in numbers.items()],
    )
    per_field = [
        F.struct(
            F.lit(f.name).alias("field_name"),
            F.lit(f.type).alias("declared_type"),
            F.count_if(f"has_{n}").alias("present"),
            F.count_if(f"bad_{n}").alias("nonconforming"),
            F.kll_sketch_agg_double(f"x_{n}", VALUE_SIZE).alias("numbers"),
        )
        for n, f in zip(names, fields)
    ]
    return rows.groupBy("part").agg(
        F.count("*").alias("row_count"),
        F.count_if("null_key").alias("null_keys"),
        F.theta_sketch_agg("key", KEY_ENTRIES).alias("keys"),
        F.array(*per_field).alias("fields"),
    )


def store_parts(parts: DataFrame, path: str) -> None:
    """Add parts to the stored ones. A part that is audited again takes its own place."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merged_keys(parts: DataFrame) -> DataFrame:
    """One row: rows, NULL keys, the estimated number of different keys and of rows that repeat one. Exact
    up to some 2^KEY_ENTRIES keys, within 1 % or so beyond."""
    merged = parts.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("null_keys"), F.lit(0)).alias("null_keys"),
        F.theta_union_agg("keys", KEY_ENTRIES).alias("keys"),
    )
    distinct = merged.withColumn("distinct_keys", F.coalesce(F.theta_sketch_estimate("keys"), F.lit(0)).cast("long"))
    repeats = F.greatest(F.col("row_count") - F.col("null_keys") - F.col("distinct_keys"), F.lit(0))
    return distinct.select("row_count", "null_keys", "distinct_keys", repeats.alias("repeated_rows"))


def merged_fields(parts: DataFrame, quantiles: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """One row per field: present, nonconforming, and quantiles of its numbers, NULL where it has none."""
    lines = parts.select(F.inline("fields")).groupBy("field_name", "declared_type").agg(
        F.sum("present").alias("present"),
        F.sum("nonconforming").alias("nonconforming"),
        F.kll_merge_agg_double("numbers", VALUE_SIZE).alias("numbers"),
    )
    found = [F.kll_sketch_get_quantile_double("numbers", F.lit(float(q))) for q in quantiles]
    known = F.when(F.kll_sketch_get_n_double("numbers") > 0, F.array(*found))
    return lines.withColumn("quantiles", known).drop("numbers")


def offenders(df: DataFrame, fields: Sequence[Field], k: int = 10) -> DataFrame:
    """Per field the `k` most frequent values that do not fit the declared type, ties by the value's text. One pass for all fields;
    only values that do not fit are moved, counted within each task first."""
    bad = F.array(
        *[
            F.when(
                df[f.name].isNotNull() & ~fits(df, f),
                F.struct(
                    F.lit(f.name).alias("field_name"),
                    F.lit(f.type).alias("declared_type"),
                    canon.raw_text(df[f.name], column_type(df, f.name)).alias("value"),
                ),
            )
            for f in fields
        ]
    )
    counted = (
        df.select(F.explode(F.array_compact(bad)).alias("b"))
        .select("b.*")
        .groupBy("field_name", "declared_type", "value")
        .agg(F.count("*").alias("occurrences"))
    )
    order = Window.partitionBy("field_name", "declared_type").orderBy(F.desc("occurrences"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
