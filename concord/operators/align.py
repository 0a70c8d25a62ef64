"""Align two sides on their keys: every distinct row of either side, paired with its partners.

Equal rows of a side are always counted, never repeated: the frame has one row per pair of distinct rows
(or per distinct one-sided row), and `copies` says how many pairs, or rows, it stands for. This holds
for every key, NULL ones included; how the work is dealt to tasks does not change the frame.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import verdict
from concord.operators.hashview import Prepared

# A key with this many rows on one side, or CELL_ROWS times as many pairs, is split over several tasks.
HOT_ROWS = 10_000
# Rows of one key, per side, that one task compares.
CELL_ROWS = 1_000
# Items that a sketch of frequent keys tracks, keys taken from it, and sketches merged in the first step.
SKETCH_ITEMS = 100_000
SKETCH_KEYS = 10_000
SKETCH_PARTS = 64


def has_null_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def key_rows(p: Prepared) -> DataFrame:
    """Rows per key on either side, counted within each task first: (keys, src_rows, tgt_rows)."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = p.source.select(*p.keys, one.alias("s"), none.alias("t")).unionAll(
        p.target.select(*p.keys, none.alias("s"), one.alias("t"))
    )
    return both.groupBy(*p.keys).agg(F.sum("s").alias("src_rows"), F.sum("t").alias("tgt_rows"))


def frequent_keys(side: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Hashes of the keys that `least` rows of one side or more may have, from mergeable sketches of frequent items.

    A task tracks a bounded number of items, the sketches are merged in two steps, and no key is moved. A key of more than
    some 7 / SKETCH_ITEMS of all rows is always found; which of the others are is of no concern, as the frame
    does not depend on it and such a key is less than a task's share.
    """
    hashed = side.where(~has_null_key(keys)).select(
        F.xxhash64(*keys).alias("item"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_PARTS)).alias("part")
    )
    sketches = hashed.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(item, {SKETCH_ITEMS})").alias("sketch"))
    # Grouped by a constant: a side without rows has no sketch, and combining none fails.
    merged = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"))
    top = merged.select(F.inline(F.expr(f"approx_top_k_estimate(sketch, {SKETCH_KEYS})")))
    return top.where(F.col("count") >= least).select("item")


def hot_keys(p: Prepared, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys to split, with their rows on either side. Lazy, and at the end a shuffle of its own, so that adaptive execution
    sees its true size when it picks the joins. Only rows of keys that the sketches name are counted per key."""
    least = min(hot_rows, (float(hot_rows) * CELL_ROWS) ** 0.5)  # either condition below asks for so many rows on one side
    named = frequent_keys(p.source, p.keys, least).unionAll(frequent_keys(p.target, p.keys, least)).distinct()

    def candidates(side: DataFrame) -> DataFrame:
        rows = side.where(~has_null_key(p.keys)).select(*p.keys, F.xxhash64(*p.keys).alias("item"))
        return rows.join(F.broadcast(named), "item", "left_semi")  # 2 * SKETCH_KEYS hashes at most

    s, t = F.col("src_rows"), F.col("tgt_rows")
    pairs = s.cast("double") * t >= float(hot_rows) * CELL_ROWS
    counted = key_rows(replace(p, source=candidates(p.source), target=candidates(p.target)))
    return counted.where((F.greatest(s, t) >= hot_rows) | pairs).repartition(*p.keys)


def align(p: Prepared, hot_rows: int | None = HOT_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Full outer join on all keys, with presence flags, copies and status.

    Rows with a NULL key have no partner and never enter the join, so they are not gathered
    into one task. Keys that `hot_keys` finds are compared cell by cell; None leaves the search out.
    """
    src, tgt = p.keyed()
    parts = []
    if hot_rows is not None:
        hot = hot_keys(p, hot_rows)
        parts = _hot_pairs(src, tgt, hot, p.keys, cell_rows)
        src = src.join(hot.select(*p.keys), p.keys, "left_anti")
        tgt = tgt.join(hot.select(*p.keys), p.keys, "left_anti")
    # Equal rows are counted where the join needs them, so that counting moves nothing.
    s = _present(_distinct(src.repartition(*p.keys), "src_copies"), "src")
    t = _present(_distinct(tgt.repartition(*p.keys), "tgt_copies"), "tgt")
    copies = F.coalesce("src_copies", F.lit(1)) * F.coalesce("tgt_copies", F.lit(1))
    parts.insert(0, s.join(t, p.keys, "full_outer").withColumn("copies", copies).drop("src_copies", "tgt_copies"))
    for df, side in zip(p.loose(), ("src", "tgt")):
        if df is not None:
            parts.append(_present(_distinct(df, "copies"), side))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("src_present", "tgt_present")}
    return rows.withColumns(flags).withColumn(
        "status",
        verdict.status(F.col("src_present"), F.col("tgt_present"), F.col("src_hash"), F.col("tgt_hash")),
    )


def _present(df: DataFrame, side: str) -> DataFrame:
    return df.withColumn(f"{side}_present", F.lit(True))


def _distinct(df: DataFrame, copies: str) -> DataFrame:
    """Distinct rows with their number. Floats are grouped by their text, which tells -0.0 from 0.0."""
    floats = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    texts = df.withColumns({c: F.col(c).cast("string") for c in floats}) if floats else df
    counted = texts.groupBy(*df.columns).agg(F.count("*").alias(copies))
    return counted.withColumns({c: F.col(c).cast(kind) for c, kind in floats.items()}) if floats else counted


def _hot_pairs(src: DataFrame, tgt: DataFrame, hot: DataFrame, keys: list[str], cell_rows: int) -> list[DataFrame]:
    """Rows of the hot keys: counted per distinct row in each task first, then compared cell by cell.

    The rows of a key are spread by a hash of their values over as many cells as their number asks for, and
    each cell of one side meets every cell of the other exactly once.
    """
    sizes = hot.select(
        *keys,
        F.ceil(F.col("src_rows") / cell_rows).alias("src_cells"),
        F.ceil(F.col("tgt_rows") / cell_rows).alias("tgt_cells"),
    )
    s = _distinct(src.join(sizes, keys), "src_copies")
    t = _distinct(tgt.join(sizes, keys), "tgt_copies")
    row, col = F.col("src_cells"), F.col("tgt_cells")
    s_cells = s.where(col > 0).select(
        *src.columns, "src_copies",
        F.pmod(F.xxhash64(*src.columns), row).alias("cell_row"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), col - 1)).alias("cell_col"),
    )
    t_cells = t.where(row > 0).select(
        *tgt.columns, "tgt_copies",
        F.explode(F.sequence(F.lit(0).cast("bigint"), row - 1)).alias("cell_row"),
        F.pmod(F.xxhash64(*tgt.columns), col).alias("cell_col"),
    )
    # A stated number of partitions: the work is in the pairs, so a cell's few bytes must not
    # lead adaptive execution to merge cells into one task.
    cell = [*keys, "cell_row", "cell_col"]
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (
        _present(s_cells, "src")
        .repartition(parts, *cell)
        .join(_present(t_cells, "tgt").repartition(parts, *cell), cell)
        .withColumn("copies", F.col("src_copies") * F.col("tgt_copies"))
        .drop("src_copies", "tgt_copies", "cell_row", "cell_col")
    )
    src_only = s.where(col == 0).select(*src.columns, F.col("src_copies").alias("copies"))
    tgt_only = t.where(row == 0).select(*tgt.columns, F.col("tgt_copies").alias("copies"))
    return [pairs, _present(src_only, "src"), _present(tgt_only, "tgt")]


def one_sided(p: Prepared) -> tuple[DataFrame, DataFrame]:
    """Rows missing on the other side, without aligning the rest: (source only, target only).

    Keys are counted on both sides in one pass; the rows of the odd ones are then looked up.
    """
    rows = key_rows(p)
    null_key = has_null_key(p.keys)

    def missing(df: DataFrame, own: str, other: str) -> DataFrame:
        keys = rows.where((F.col(own) > 0) & (F.col(other) == 0) & ~null_key).select(*p.keys).repartition(*p.keys)
        return df.join(keys, p.keys, "left_semi").select(*df.columns)

    src, tgt = p.keyed()
    found = [missing(src, "src_rows", "tgt_rows"), missing(tgt, "tgt_rows", "src_rows")]
    s, t = (f if loose is None else f.unionAll(loose) for f, loose in zip(found, p.loose()))
    return s, t


def key_tally(p: Prepared) -> DataFrame:
    """Row and pair counts per key, by arithmetic instead of by joining.

    Equal hashes of a key are counted on both sides and multiplied, so a key repeated on both
    sides costs no more than its distinct hashes. Rows with a NULL key are counted per side.
    """
    counts = []
    for df, side, s, t in ((p.source, "src", 1, 0), (p.target, "tgt", 0, 1)):
        counts.append(
            df.select(
                *p.keys,
                F.col(f"{side}_hash").alias("hash"),
                F.when(has_null_key(p.keys), side).alias("loose_side"),
                F.lit(s).cast("bigint").alias("s"),
                F.lit(t).cast("bigint").alias("t"),
            )
        )
    per_hash = counts[0].unionAll(counts[1]).groupBy(*p.keys, "loose_side", "hash").agg(
        F.sum("s").alias("s"), F.sum("t").alias("t")
    )
    matched = F.when(F.col("hash").isNotNull() & F.col("loose_side").isNull(), F.col("s") * F.col("t")).otherwise(0)
    per_key = per_hash.groupBy(*p.keys, "loose_side").agg(
        F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"), F.sum(matched).alias("matched")
    )
    s, t = F.col("source_rows"), F.col("target_rows")
    return per_key.select(
        *p.keys,
        s,
        t,
        "matched",
        (s * t - F.col("matched")).alias("mismatched"),
        F.when(t == 0, s).otherwise(0).alias("source_only"),
        F.when(s == 0, t).otherwise(0).alias("target_only"),
    )
