"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.operators.locate import FILE, ROW, located

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local session may do without the setting."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="concord-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, so a lost
    executor costs the tasks that it ran and not the steps before. Shuffle files of the finished
    job are let go."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    schema = frame.schema
    del frame
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Rows of an Arrow batch: whole texts of any length, so fewer than the usual 10,000.
BATCH_ROWS = 1000


def shipped(spark: SparkSession) -> None:
    """Make this package importable on the executors, wherever the driver was started, and bound the batches that
    are sent to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_concord_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="concord-")), "concord.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._concord_shipped = True


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32 of a key as text, modulo `buckets`; 0 for a NULL key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % buckets, F.lit(0))


#: Names of files that may be broadcast: some 4 MB.
BROADCAST_FILES = 20_000
ROW_BITS = 40


def numbered(frame: DataFrame, column: str, name: str = "rows") -> DataFrame:
    """The frame with a `column` that tells rows apart and is the same in every job. Rows of Parquet scans are numbered by
    file and place and stay where they are. Others are stored, with a number that is written once: Spark packs files into
    partitions anew in every job, by the cores it has then, and a number computed again may differ. So are rows of more files
    than may be broadcast."""
    placed = located(frame)
    if placed is not None:
        files = placed.select(FILE).distinct()
        files = saved(files.withColumn("number", F.row_number().over(Window.orderBy(FILE))), "files") if files.count() <= BROADCAST_FILES else None
    if placed is None or files is None:
        return saved(frame.withColumn(column, F.monotonically_increasing_id()), name)
    number = F.shiftleft(F.col("number").cast("long"), ROW_BITS).bitwiseOR(F.col(ROW))
    return placed.join(F.broadcast(files), FILE).select(*(F.col(f"`{c}`") for c in frame.columns), number.alias(column))


#: Ids of eight bytes that may be broadcast: 32 MB.
BROADCAST_IDS = 4_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A left_semi or left_anti join on the one column of `ids`, whole numbers from a stored table. They are counted
    first and broadcast if they are few; then the rows stay where they are. More of them are shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, ids.columns[0], how)


def forget(frame: DataFrame) -> None:
    """Delete the files of a frame that `saved` returned and that nothing will read again."""
    spark = frame.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
