"""Row status, verdicts and the texts that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.domain import DEFAULT_VARIANCE
from concord.functions.variance import exceeds

# Statuses, discrepancy types, verdicts and their texts.
MATCH = "MATCH"
MISMATCH = "MISMATCH"
SOURCE_ONLY = "SOURCE_ONLY"
TARGET_ONLY = "TARGET_ONLY"

DISCREPANCY_TYPE = {
    MISMATCH: "HASH_MISMATCH",
    SOURCE_ONLY: "MISSING_IN_TARGET",
    TARGET_ONLY: "MISSING_IN_SOURCE",
}
DETAILS = {
    MISMATCH: "Record hash differs between source and target",
    SOURCE_ONLY: "Record exists only in source",
    TARGET_ONLY: "Record exists only in target",
}
TYPE_DESCRIPTION = {
    "MISSING_IN_TARGET": "Record exists in source but not in target",
    "MISSING_IN_SOURCE": "Record exists in target but not in source",
    "HASH_MISMATCH": "Record hashes differ between source and target",
}

PRISTINE = "PRISTINE"
NOISY = "NOISY"
MATERIAL = "MATERIAL"

VERDICT_DESCRIPTION = {
    PRISTINE: "Pristine - Record hashes match exactly",
    NOISY: "Noisy - Minor differences (variance <= 1% on all fields)",
    MATERIAL: "Material - Significant differences (variance > 1% on some fields)",
}


def lookup(c: Column, texts: dict[str, str]) -> Column:
    """The text a code stands for, NULL for an unknown code."""
    branches = [F.when(c == code, F.lit(text)) for code, text in texts.items()]
    return F.coalesce(*branches)


def status(src_present: Column, tgt_present: Column, src_hash: Column, tgt_hash: Column) -> Column:
    """Decided by the presence of the row on each side, so a NULL key does not flip the side."""
    return (
        F.when(~tgt_present, SOURCE_ONLY)
        .when(~src_present, TARGET_ONLY)
        .when(src_hash == tgt_hash, MATCH)
        .otherwise(MISMATCH)
    )


def fields_within(pcts: Sequence[str], threshold: float) -> Column:
    """Number of pairs that do not exceed the threshold."""
    return F.expr(" + ".join(f"if({exceeds(p, threshold)}, 0, 1)" for p in pcts) or "0")


def fields_exceeding(pcts: Sequence[str], threshold: float = DEFAULT_VARIANCE) -> Column:
    return F.expr(" + ".join(f"if({exceeds(p, threshold)}, 1, 0)" for p in pcts) or "0")


def field_match_pct(matching: str, total: int) -> Column:
    return F.expr(f"{matching} / {float(total)!r}D * 100D" if total else "0D")


def largest(pcts: Sequence[str]) -> Column:
    """Largest percentage, NULLs ignored; NULL when there is none."""
    if not pcts:
        return F.lit(None).cast("double")
    return F.col(pcts[0]) if len(pcts) == 1 else F.greatest(*pcts)


def slo_verdict(slo_target: float) -> Column:
    """The verdict that drives the counts: share of fields within the threshold against the target."""
    return F.expr(
        f"""CASE WHEN status = '{MATCH}' THEN '{PRISTINE}'
                 WHEN status = '{MISMATCH}' AND field_match_pct >= {float(slo_target)!r}D THEN '{NOISY}'
                 ELSE '{MATERIAL}' END"""
    )


def strict_verdict(total: int) -> Column:
    """Any field over the default threshold is material, whatever the domain's own thresholds.

    Two missing hashes count as equal here, though the row's status is MISMATCH.
    """
    paired = f"status IN ('{MATCH}', '{MISMATCH}')"
    quiet = f"{paired} AND excessive_fields = 0" if total else "false"
    return F.expr(
        f"""CASE WHEN {paired} AND coalesce(src_hash, '') = coalesce(tgt_hash, '') THEN '{PRISTINE}'
                 WHEN {quiet} THEN '{NOISY}' ELSE '{MATERIAL}' END"""
    )
