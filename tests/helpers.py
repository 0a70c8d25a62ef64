"""Small frames and a plain-Python reconciliation to compare with."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from concord import Domain, Field, Side


def domain(name="pair", keys=1, **options) -> Domain:
    side = Side(
        "t",
        tuple(Field(f"id{i}", "BIGINT") for i in range(1, keys + 1)),
        (Field("amount", "DECIMAL"), Field("note", "STRING")),
    )
    return Domain(name, side, side, **options)


def frame(spark, rows, keys=1):
    ids = ", ".join(f"id{i} bigint" for i in range(1, keys + 1))
    return spark.createDataFrame(rows, f"{ids}, amount decimal(15,2), note string")


def text(value) -> str:
    return "NULL" if value is None else str(value)


def digest(amount, note) -> str:
    amount = "NULL" if amount is None else f"{amount:.2f}"
    return hashlib.md5(f"{amount}|{text(note)}".encode()).hexdigest()


def number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def variance(a, b):
    """(type, percentage) of a pair."""
    if a is None and b is None:
        return "EXACT_MATCH", 0.0
    if a is None or b is None:
        return "NULL_MISMATCH", 100.0
    if str(a) == str(b):
        return "EXACT_MATCH", 0.0
    x, y = number(a), number(b)
    if x is None or y is None:
        return "TEXT", None
    base = abs(x) or abs(y)
    return "NUMERIC", abs(x - y) / base * 100.0 if base else 0.0


def exceeds(pct, limit):
    return pct is not None and not math.isnan(pct) and pct > limit


def brute_force(source, target, keys=1, slo=95.0, limit=1.0) -> Counter:
    """Counter of (key, source hash, target hash, status, verdict, strict verdict) over all joined pairs."""
    out = Counter()
    seen = set()
    for s in source:
        sk, sh = s[:keys], digest(*s[keys:])
        partners = [] if None in sk else [(i, t) for i, t in enumerate(target) if t[:keys] == sk]
        if not partners:
            out[sk, sh, None, "SOURCE_ONLY", "MATERIAL", "MATERIAL"] += 1
        for i, t in partners:
            seen.add(i)
            th = digest(*t[keys:])
            if sh == th:
                out[sk, sh, th, "MATCH", "PRISTINE", "PRISTINE"] += 1
                continue
            pcts = [variance(a, b)[1] for a, b in zip(s[keys:], t[keys:])]
            within = sum(not exceeds(p, limit) for p in pcts) / len(pcts) * 100.0
            out[
                sk, sh, th, "MISMATCH",
                "NOISY" if within >= slo else "MATERIAL",
                "MATERIAL" if any(exceeds(p, 1.0) for p in pcts) else "NOISY",
            ] += 1
    for i, t in enumerate(target):
        if i not in seen:
            out[t[:keys], None, digest(*t[keys:]), "TARGET_ONLY", "MATERIAL", "MATERIAL"] += 1
    return out


def counted(judged, keys=1) -> Counter:
    """The same counter from a judged frame."""
    out = Counter()
    for r in judged.collect():
        key = tuple(r[f"k_{i}"] for i in range(1, keys + 1))
        out[key, r["src_hash"], r["tgt_hash"], r["status"], r["verdict"], r["strict_verdict"]] += r["copies"]
    return out
