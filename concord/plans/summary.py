"""Counts, gates and breakdowns of a reconciliation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.domain import Domain
from concord.functions import verdict

# The gates, in percent of matched records.
ACCEPTABLE_PCT = 99.0
APPROVAL_PCT = 95.0

STATUS_COUNTS = ("total_source", "total_target", "matched", "mismatched", "source_only", "target_only")
COUNTS = (*STATUS_COUNTS, "pristine", "noisy", "material")
DISCREPANCIES = "mismatched + source_only + target_only"


def summarize(judged: DataFrame, source: DataFrame, target: DataFrame, domain: Domain) -> DataFrame:
    """One row per domain.

    Totals count the sides themselves, since a repeated key makes more pairs than rows; Parquet answers
    that from its footers. The one-row aggregates are stacked and added up.
    """
    counted = judged.agg(
        copies_of("status", verdict.MATCH).alias("matched"),
        copies_of("status", verdict.MISMATCH).alias("mismatched"),
        copies_of("status", verdict.SOURCE_ONLY).alias("source_only"),
        copies_of("status", verdict.TARGET_ONLY).alias("target_only"),
        copies_of("verdict", verdict.PRISTINE).alias("pristine"),
        copies_of("verdict", verdict.NOISY).alias("noisy"),
        copies_of("verdict", verdict.MATERIAL).alias("material"),
    )
    parts = [
        counted,
        source.agg(F.count("*").alias("total_source")),
        target.agg(F.count("*").alias("total_target")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    totals = stacked.agg(*[F.expr(f"coalesce(sum({c}), 0)").alias(c) for c in COUNTS])
    return gates(totals.select(F.lit(domain.name).alias("domain"), *COUNTS))


def copies_of(column: str, value: str) -> Column:
    """Number of records with a status or verdict, as an aggregate."""
    return F.expr(f"sum(if({column} = '{value}', copies, 0))")


def count_statuses(tally: DataFrame, domain: Domain) -> DataFrame:
    """One row of totals, status counts and match percentage from the counts per key.

    No pair is formed, so repeated keys cost nothing extra; verdicts need the pairs and are
    left to `summarize`.
    """
    source = {"total_source": "source_rows", "total_target": "target_rows"}
    counts = [F.expr(f"coalesce(sum({source.get(c, c)}), 0)").alias(c) for c in STATUS_COUNTS]
    pct = match_pct(F.col("matched"), F.col("total_source"), F.col("total_target"))
    return (
        tally.agg(*counts)
        .select(F.lit(domain.name).alias("domain"), *STATUS_COUNTS)
        .withColumns({"match_pct": pct, "total_discrepancies": F.expr(DISCREPANCIES)})
    )


def match_pct(matched: Column, total_source: Column, total_target: Column) -> Column:
    larger = F.greatest(total_source, total_target)
    return F.when(larger == 0, F.lit(100.0)).otherwise(matched * F.lit(100.0) / larger)


def gates(counts: DataFrame) -> DataFrame:
    """Add the match percentage, the number of discrepancies and the three gates."""
    pct = match_pct(F.col("matched"), F.col("total_source"), F.col("total_target"))
    return counts.withColumn("match_pct", pct).withColumns(
        {
            "total_discrepancies": F.expr(DISCREPANCIES),
            "passed": F.expr("material = 0"),
            "acceptable": F.col("match_pct") >= ACCEPTABLE_PCT,
            "needs_approval": F.expr(f"material > 0 OR match_pct < {APPROVAL_PCT}"),
        }
    )


# Fixed values from here to the end of `text_line`: the labels of the maps and the wording of the line.
def record_breakdown() -> Column:
    """Map of the four record counts of a summary row."""
    return F.create_map(
        F.lit("matched"), "matched", F.lit("mismatched"), "mismatched",
        F.lit("sourceOnly"), "source_only", F.lit("targetOnly"), "target_only",
    )


def verdict_breakdown() -> Column:
    """Map of the three verdict counts of a summary row."""
    return F.create_map(
        F.lit(verdict.PRISTINE), "pristine", F.lit(verdict.NOISY), "noisy", F.lit(verdict.MATERIAL), "material"
    )


def verdict_count(name: str) -> Column:
    """Count for one verdict."""
    if name not in verdict.VERDICT_DESCRIPTION:
        raise ValueError(f"unknown verdict {name!r}")
    return F.col(name.lower())


def text_line() -> Column:
    """A summary row as one line of text."""
    return F.format_string(
        "Reconciliation: %d/%d matched (%.1f%%), %d pristine, %d noisy, %d material",
        F.col("matched"), F.greatest("total_source", "total_target"), F.col("match_pct"),
        F.col("pristine"), F.col("noisy"), F.col("material"),
    )


def breakdown(judged: DataFrame, column: str) -> DataFrame:
    """Number of records per status or verdict."""
    return judged.groupBy(column).agg(F.sum("copies").alias("records"))


def union_summaries(summaries: Iterable[DataFrame]) -> DataFrame:
    """One row per domain of a run over several domains."""
    return reduce(lambda a, b: a.unionByName(b), summaries)
