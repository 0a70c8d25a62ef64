"""Reports: the result as JSON, CSV lines, a run log, and views for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import verdict
from concord.operators.records import record
from concord.plans.reconcile import Result
from concord.plans.summary import COUNTS


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a frame readable from SQL under a name of the caller's choice."""
    df.createOrReplaceTempView(name)
    return df


# Fixed values from here to `discrepancy_objects`: the names and the shape of the JSON report.
def summary_json() -> Column:
    """A summary row as a JSON object."""
    return F.to_json(
        F.struct(
            F.col("domain"),
            F.col("total_source").alias("totalSourceRecords"),
            F.col("total_target").alias("totalTargetRecords"),
            F.col("matched").alias("matchedRecords"),
            F.col("mismatched").alias("mismatchedRecords"),
            F.col("source_only").alias("sourceOnlyRecords"),
            F.col("target_only").alias("targetOnlyRecords"),
            F.col("match_pct").alias("matchPercentage"),
            F.col("pristine").alias("pristineCount"),
            F.col("noisy").alias("noisyCount"),
            F.col("material").alias("materialCount"),
        )
    )


def discrepancy_objects(result: Result) -> DataFrame:
    """Discrepancies in the shape of the JSON report, one object per row."""
    def side(name: str) -> Column:
        r = record(result.keys, result.pairs, name)
        shape = F.struct(
            r["id"].alias("id"), r["record_hash"].alias("recordHash"), r["side"].alias("source"), r["fields"].alias("fields")
        )
        return F.when(r.isNotNull(), shape)

    variances = F.transform(
        "variances",
        lambda v: F.struct(
            v["field_name"].alias("fieldName"),
            v["source_value"].alias("sourceValue"),
            v["target_value"].alias("targetValue"),
            v["variance_pct"].alias("variancePercentage"),
            v["variance_type"].alias("varianceType"),
        ),
    )
    return result.discrepancies.select(
        F.col("discrepancy_type").alias("discrepancyType"),
        F.col("verdict"),
        F.col("strict_verdict").alias("strictVerdict"),
        F.col("copies"),
        side("source").alias("sourceRecord"),
        side("target").alias("targetRecord"),
        F.col("details"),
        variances.alias("fieldVariances"),
    )


def discrepancy_json(result: Result) -> DataFrame:
    """Discrepancies as JSON text, one per row."""
    df = discrepancy_objects(result)
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("discrepancy"))


def descriptions(df: DataFrame) -> DataFrame:
    """Add the texts of the discrepancy type and the verdict."""
    return df.withColumns(
        {
            "type_description": verdict.lookup(F.col("discrepancy_type"), verdict.TYPE_DESCRIPTION),
            "verdict_description": verdict.lookup(F.col("verdict"), verdict.VERDICT_DESCRIPTION),
        }
    )


def write_json(result: Result, path: str) -> None:
    """`path/summary` and `path/discrepancies` as JSON lines, written by the executors."""
    result.summary.select(summary_json().alias("value")).write.mode("overwrite").text(f"{path}/summary")
    discrepancy_objects(result).write.mode("overwrite").option("ignoreNullFields", "false").json(
        f"{path}/discrepancies"
    )


def write_csv(discrepancies: DataFrame, path: str) -> None:
    """Type, id, details and copies of each discrepancy."""
    discrepancies.select("discrepancy_type", "record_id", "details", "copies").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def stamped(summary: DataFrame) -> DataFrame:
    """The summary with the time of the run."""
    return summary.withColumn("executed_at", F.current_timestamp())


def append_run(summary: DataFrame, path: str, run_id: str) -> None:
    """Put a summary into the run log, partitioned by domain and run. A run that is logged again, as after a failure, takes its own place."""
    if not run_id:
        raise ValueError("a run needs an id")
    rows = stamped(summary).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "run_id").parquet(path)


LOGGED = (
    ", ".join(f"{c} long" for c in COUNTS)
    + ", match_pct double, total_discrepancies long, passed boolean, acceptable boolean, needs_approval boolean, executed_at timestamp, domain string, run_id string"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log: one row per domain and run."""
    return spark.read.schema(LOGGED).parquet(path)


def run_trend(runs: DataFrame, order: str = "executed_at") -> DataFrame:
    """Every run with what changed since the run before it of the same domain: NULL for the first. `order` may be `run_id` where ids sort."""
    before = Window.partitionBy("domain").orderBy(order, "run_id")
    return runs.select(
        "domain",
        "run_id",
        F.row_number().over(before).alias("run"),
        "match_pct",
        (F.col("match_pct") - F.lag("match_pct").over(before)).alias("match_change"),
        "total_discrepancies",
        (F.col("total_discrepancies") - F.lag("total_discrepancies").over(before)).alias("discrepancy_change"),
        (F.col("passed") & ~F.lag("passed").over(before)).alias("mended"),
        (~F.col("passed") & F.lag("passed").over(before)).alias("broken"),
    )
