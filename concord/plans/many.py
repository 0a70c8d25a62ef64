"""Several domains in one pass: the rows of all are dealt by (domain, key), aligned once and counted once.

Tables are scanned per domain, as they must be; what follows a scan does not grow with the number of domains. Keys, hashes and
compared values travel as texts, so that rows of different domains have the same columns. Values are in their short
form; the numbers that variances need are read from them where rows differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import Domain
from concord.functions import variance, verdict
from concord.functions.canon import raw_text
from concord.operators.align import HOT_ROWS, align
from concord.operators.hashview import PairColumns, Prepared, prepare
from concord.plans import contracts
from concord.plans.reconcile import pair_value
from concord.plans.summary import COUNTS, copies_of, gates

Sides = tuple[DataFrame, DataFrame, Domain]


def summaries(sides: Sequence[Sides], *, use_hash_column: bool = False, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row of counts and gates per domain, as `Result.summary` has it. Starts no job. Names of domains must differ."""
    domains = [d for _, _, d in sides]
    if not domains:
        raise ValueError("no domains")
    if len({d.name for d in domains}) < len(domains):
        raise ValueError("two domains have the same name")
    for source, target, d in sides:
        contracts.require(source, target, d, use_hash_column)
    groups = _same_sides(sides)
    first = [g[0] for g in groups]
    rows = align(_multiplexed([prepare(s, t, d, use_hash_column).short() for s, t, d in first], [d for _, _, d in first]), hot_rows)
    for own in (g for g in groups if len(g) > 1):
        names = F.array(*[F.lit(d.name) for _, _, d in own])
        rows = rows.withColumn("domain", F.explode(F.when(F.col("domain") == own[0][2].name, names).otherwise(F.array("domain"))))
    counted = _verdicts(rows, domains).groupBy("domain").agg(
        *[copies_of("status", getattr(verdict, c)).alias(n) for c, n in _STATUSES.items()],
        *[copies_of("verdict", getattr(verdict, c)).alias(n) for c, n in _VERDICTS.items()],
    )
    # Totals count the sides themselves; without columns, Parquet answers from its footers.
    sizes = [
        df.select(F.lit(d.name).alias("domain"), F.lit(i).alias("side")) for s, t, d in sides for i, df in enumerate((s, t))
    ]
    totals = reduce(DataFrame.unionAll, sizes).groupBy("domain").agg(
        F.count_if(F.col("side") == 0).alias("total_source"), F.count_if(F.col("side") == 1).alias("total_target")
    )
    spark = rows.sparkSession
    named = spark.range(1).select(F.explode(F.array(*[F.lit(d.name) for d in domains])).alias("domain"))  # also those without rows
    parts = [counted, totals, named]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return gates(stacked.groupBy("domain").agg(*[F.expr(f"coalesce(sum({c}), 0)").alias(c) for c in COUNTS]))


_STATUSES = {"MATCH": "matched", "MISMATCH": "mismatched", "SOURCE_ONLY": "source_only", "TARGET_ONLY": "target_only"}
_VERDICTS = {"PRISTINE": "pristine", "NOISY": "noisy", "MATERIAL": "material"}


def _same_sides(sides: Sequence[Sides]) -> list[list[Sides]]:
    """Domains that differ in nothing but thresholds are aligned once."""
    groups: list[list[Sides]] = []
    for s, t, d in sides:
        for g in groups:
            source, target, first = g[0]
            alike = replace(d, name=first.name, slo_target=first.slo_target, variance_threshold=first.variance_threshold) == first
            # Equal plans may name their columns otherwise.
            if alike and all(a.schema == b.schema and a.sameSemantics(b) for a, b in ((s, source), (t, target))):
                g.append((s, t, d))
                break
        else:
            groups.append([(s, t, d)])
    return groups


def _multiplexed(prepared: Sequence[Prepared], domains: Sequence[Domain]) -> Prepared:
    """The rows of all domains under the same columns: domain, keys as text, values as (text, number), hash. The domain is the last
    of the keys: rows are sorted by the first bytes of the first one, which should tell them apart."""
    width = max(len(p.keys) for p in prepared)
    keys = [*[f"k_{i + 1}" for i in range(width)], "domain"]

    def side(df: DataFrame, p: Prepared, d: Domain, end: str) -> DataFrame:
        own = [_key_text(F.col(k), df.schema[k].dataType).alias(k) for k in p.keys]
        none = [F.lit("").alias(k) for k in keys[len(own) : -1]]  # no key of this domain
        values = F.array(*[_value(q, 0 if end == "src" else 1) for q in p.pairs]).alias(f"{end}_values")
        return df.select(F.lit(d.name).alias("domain"), *own, *none, values, F.col(f"{end}_hash").cast("string").alias(f"{end}_hash"))

    def united(pick: Callable[[Prepared], DataFrame | None], end: str) -> DataFrame | None:
        found = [side(pick(p), p, d, end) for p, d in zip(prepared, domains) if pick(p) is not None]
        if not found:
            return None
        # Spark takes joins that filter into every branch of a union, with an exchange each. An expression that is not deterministic,
        # here an addition of nothing, keeps them above it.
        nothing = F.when(F.spark_partition_id() < 0, "-").otherwise("")
        return reduce(DataFrame.unionAll, found).withColumn("domain", F.concat("domain", nothing))

    return Prepared(
        united(lambda p: p.source, "src"),
        united(lambda p: p.target, "tgt"),
        keys,
        [],
        united(lambda p: p.null_source, "src"),
        united(lambda p: p.null_target, "tgt"),
    )


def _own_text(c: Column, dtype: T.DataType) -> Column:
    """A text that differs where the values differ: the usual one of a timestamp repeats an hour when clocks are put back."""
    return F.unix_micros(c).cast("string") if isinstance(dtype, T.TimestampType) else raw_text(c, dtype)


def _key_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, "0.0").otherwise(c.cast("string"))  # as a join does, with one zero
    return _own_text(c, dtype)


def _value(pair: PairColumns, at: int) -> Column:
    """A value's text and, as a text too, its number: NULL where the text says it, empty where there is none. Doubles among
    the columns that rows are counted by would be normalised one by one, without generated code."""
    name, dtype = pair.sides()[at]
    c, number = pair_value(name, dtype, short=True)
    text = _own_text(c, dtype) if pair.src_type == pair.tgt_type else raw_text(c, dtype)
    if isinstance(dtype, T.NumericType):
        said = F.lit(None).cast("string")
    else:
        said = F.coalesce(number.cast("string"), F.lit("")) if isinstance(dtype, T.StringType) else F.lit("")
    return F.struct(text.alias("text"), said.alias("number"))


def _number(value: Column) -> Column:
    said = F.coalesce(value["number"], value["text"])
    return F.when(said != "", said.cast("double"))


def _measured(a: Column, b: Column) -> Column:
    nulls = a["text"].isNull().cast("int") + b["text"].isNull().cast("int")
    return F.struct(nulls.alias("nulls"), (a["text"] == b["text"]).alias("same"), _number(a).alias("src"), _number(b).alias("tgt"))


def _verdicts(rows: DataFrame, domains: Sequence[Domain]) -> DataFrame:
    """Domain, status, verdict and copies of every aligned row. Fields are measured one after the other in functions over the arrays of
    values: as columns of their own they make generated code that is too long for Java to compile."""
    kind = variance.type_sql("m.nulls", "m.same", "m.src", "m.tgt")
    pct = variance.pct_sql("m.kind", "m.src", "m.tgt")
    mismatch = F.col("status") == verdict.MISMATCH
    pcts = F.expr(f"transform(transform(_measured, m -> named_struct('kind', {kind}, 'src', m.src, 'tgt', m.tgt)), m -> {pct})")

    def by_domain(setting: Callable[[Domain], float], column: Callable[[float], Column]) -> Column:
        names: dict[float, list[str]] = {}
        for d in domains:
            names.setdefault(setting(d), []).append(d.name)
        return F.coalesce(*[F.when(F.col("domain").isin(own), column(value)) for value, own in names.items()])

    def within(limit: float) -> Column:
        return F.expr(f"total_fields - size(filter(_pcts, p -> {variance.exceeds('p', limit)}))")

    return (
        rows.withColumn("_measured", F.when(mismatch, F.zip_with("src_values", "tgt_values", _measured)))
        .withColumn("_pcts", pcts)
        .withColumn("total_fields", by_domain(lambda d: float(len(d.field_pairs())), F.lit))
        .withColumn("matching_fields", by_domain(lambda d: d.variance_threshold, within))
        .withColumn("field_match_pct", F.expr("if(total_fields = 0, 0D, matching_fields / total_fields * 100D)"))
        .select("domain", "status", by_domain(lambda d: d.slo_target, verdict.slo_verdict).alias("verdict"), "copies")
    )
