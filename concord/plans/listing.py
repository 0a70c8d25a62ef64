"""A discrepancy list stored in the order of its pages, so that a page costs the files that hold it and no alignment."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from concord.operators.discrepancies import behind, line_order, lines_of
from concord.plans.reconcile import checked_folder, shared_folder

#: Lines of a file, about.
FILE_LINES = 100_000


@dataclass(frozen=True)
class Listing:
    """Stored lines, and per file its number of lines and its last line. Files follow on one another in the order of the lines."""

    lines: DataFrame
    files: DataFrame
    order: tuple[str, ...]

    def page(self, size: int, after: Row | None = None) -> DataFrame:
        """The next `size` lines after a line. The driver sees names and counts of the files that hold them, and no others are opened."""
        left = self.files if after is None else self.files.where(behind(self.files, list(self.order), after))
        wanted, found = [], 0
        # The first file may be read up to its end already: only the files behind it are sure to be full.
        for row in left.orderBy("file").select("file", "n").limit(2 + size).toLocalIterator():
            wanted.append(row["file"])
            found += row["n"] if after is None or len(wanted) > 1 else 0
            if found >= size:
                break
        own = self.lines.where(F.col("_metadata.file_path").isin(wanted))
        rows = own if after is None else own.where(behind(own, list(self.order), after))
        return rows.orderBy(*self.order).limit(size)


def stored_listing(discrepancies: DataFrame, folder: str | None = None, file_lines: int = FILE_LINES) -> Listing:
    """Write the lines of a discrepancy frame, equal ones as one with their number of copies, in files of one range of keys each."""
    spark = discrepancies.sparkSession
    base = checked_folder(spark, folder) if folder else shared_folder(spark)
    order, unsorted, path = line_order(discrepancies), f"{base}/listing-{uuid.uuid4()}", f"{base}/listing-{uuid.uuid4()}"
    # Stored before it is dealt into ranges: their bounds are sampled, which would align the sides once more.
    lines_of(discrepancies).write.parquet(unsorted)
    lines = spark.read.parquet(unsorted)
    number = max(1, -(-lines.count() // file_lines))
    lines.repartitionByRange(number, *order).sortWithinPartitions(*order).write.parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)
    last = F.max(F.struct(*order)).alias("last")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), last)
    index = f"{base}/listing-{uuid.uuid4()}"
    files.select("file", "n", "last.*").write.parquet(index)
    source = spark._jvm.org.apache.hadoop.fs.Path(unsorted)
    source.getFileSystem(spark._jsc.hadoopConfiguration()).delete(source, True)
    return Listing(stored, spark.read.parquet(index), tuple(order))
