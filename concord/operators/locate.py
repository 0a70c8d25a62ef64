"""Rows found again by file and position, so that wide values are read only where they are wanted.

Parquet scans know the file and the row number of each row. A locator is that pair, and only files that hold a wanted row are opened.
Rows are fetched where they lie: locators become marks, a bit per row of the blocks of `BLOCK_ROWS` rows that hold a wanted one. Marks
are dealt into lots that may be broadcast, each with its own files, so that no row is shuffled whether few or many are wanted; all lots
together take a bit per row of the files, however many rows are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, ROW = "_file", "_row"
BLOCK, BITS = "_block", "_bits"
#: Rows of a block, whose marks are 512 numbers of 64 bits.
BLOCK_ROWS = 32_768
#: Row numbers of a lot, 8 MB of marks, and files, of which each has a block of 4 KB at least.
LOT_ROWS = 2_048 * BLOCK_ROWS
LOT_FILES = 1_000


def is_scan(df: DataFrame) -> bool:
    """Whether each row of the frame is a row of a file, the same ones in every job: a scan under projections and filters without
    chance. Joins and generators repeat rows, limits choose them anew."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def located(df: DataFrame) -> DataFrame | None:
    """The frame with its rows' file and row number; None unless it is a projection or filter of a scan that knows them."""
    if not is_scan(df):
        return None
    try:
        return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return None


@dataclass(frozen=True)
class Lot:
    files: list[str]
    first: int | None = None
    last: int | None = None


def lots(locators: DataFrame, rows: int = LOT_ROWS, files: int = LOT_FILES) -> list[Lot]:
    """Files, as many as stay below `rows` locators together; a file with more is cut by row number. The driver sees one row per
    `rows` row numbers of a file. Marks count as locators of blocks."""
    cut = F.floor(F.col(ROW) / rows).alias("cut")
    counts = sorted((r[FILE], r["cut"], r["n"]) for r in locators.groupBy(FILE, cut).agg(F.count("*").alias("n")).collect())
    per_file: dict[str, int] = {}
    for file, _, n in counts:
        per_file[file] = per_file.get(file, 0) + n
    out = [Lot([file], at * rows, (at + 1) * rows) for file, at, _ in counts if per_file[file] > rows]
    held: list[str] = []
    total = 0
    for file, n in per_file.items():
        if n > rows:
            continue
        if held and (total + n > rows or len(held) >= files):
            out.append(Lot(held))
            held, total = [], 0
        held, total = [*held, file], total + n
    return [*out, Lot(held)] if held else out


def marks(locators: DataFrame) -> DataFrame:
    """The locators as bits: (file, block, numbers of 64 bits), one row per block that has any."""
    place, within = F.col(ROW), F.pmod(F.col(ROW), F.lit(BLOCK_ROWS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(within, F.lit(64)))
    words = locators.groupBy(FILE, F.floor(place / BLOCK_ROWS).alias(BLOCK), F.floor(within / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    per_block = words.groupBy(FILE, BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    all_words = F.sequence(F.lit(0), F.lit(BLOCK_ROWS // 64 - 1))
    return per_block.select(FILE, BLOCK, F.transform(all_words, lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("bigint"))).alias(BITS))


def fetch(df: DataFrame, wanted: DataFrame, rows: int = LOT_ROWS) -> DataFrame:
    """The rows of `df` that `wanted` names, a stored frame of marks or of locators. The columns are those of `df`."""
    whole = located(df)
    if whole is None:
        raise ValueError("the rows of this frame have no place in a file")
    if BITS not in wanted.columns:
        wanted = marks(wanted)
    within = F.pmod(F.col(ROW), F.lit(BLOCK_ROWS)).cast("int")
    marked = F.getbit(F.get(F.col(BITS), F.floor(within / 64).cast("int")), F.pmod(within, F.lit(64))) == 1
    whole = whole.withColumn(BLOCK, F.floor(F.col(ROW) / BLOCK_ROWS))
    parts = []
    for lot in lots(wanted.select(FILE, F.col(BLOCK).alias(ROW)), max(1, rows // BLOCK_ROWS)):
        own, bits = (side.where(F.col(FILE).isin(lot.files)) for side in (whole, wanted))
        if lot.first is not None:
            inside = F.col(BLOCK).between(lot.first, lot.last - 1)
            own, bits = own.where(inside), bits.where(inside)
        parts.append(own.join(F.broadcast(bits), [FILE, BLOCK]).where(marked).select(*df.columns))  # LOT_ROWS bits at most
    return reduce(DataFrame.unionAll, parts) if parts else df.where(F.lit(False))
