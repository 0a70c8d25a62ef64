"""Reconcile two relations: align, measure, judge, count."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import Domain
from concord.functions import canon, variance, verdict
from concord.operators.align import HOT_ROWS, align, has_null_key, key_tally
from concord.operators.hashview import PairColumns, Prepared, number_column, prepare, short_column
from concord.operators.locate import FILE, ROW, fetch, located, marks
from concord.operators.records import record_id
from concord.plans import contracts
from concord.plans.summary import count_statuses, summarize


#: Keys that do not match, up to which Spark may send them to every executor; more are shuffled.
SENT_KEYS = 200_000


@dataclass(frozen=True)
class Result:
    """Lazy frames; nothing has been computed.

    Equal rows are counted over the columns that a frame is made from, so each frame is aligned
    from as few as it needs. `stored` are aligned rows that exist already (see `checkpointed`).
    """

    domain: Domain
    source: DataFrame
    target: DataFrame
    prepared: Prepared
    stored: DataFrame | None = None
    hot_rows: int | None = HOT_ROWS

    @property
    def rows(self) -> DataFrame:
        """The aligned rows with the extra columns of text fields (see PairColumns)."""
        return self._aligned(self.prepared)

    def _aligned(self, prepared: Prepared) -> DataFrame:
        return align(prepared, self.hot_rows) if self.stored is None else self.stored

    @property
    def keys(self) -> list[str]:
        return self.prepared.keys

    @property
    def pairs(self) -> list[PairColumns]:
        return self.prepared.pairs

    @property
    def aligned(self) -> DataFrame:
        """Every joined pair and one-sided row, with hashes, compared columns and status."""
        return without_extras(self.rows)

    @property
    def statuses(self) -> DataFrame:
        """Keys, presence, hashes and status: one row per pair of distinct hashes. Moves nothing else."""
        return self._aligned(self.prepared.thin()).select(
            *self.keys, "src_present", "tgt_present", "src_hash", "tgt_hash", "status", "copies"
        )

    @property
    def judged(self) -> DataFrame:
        """Every aligned row with its compared columns, field counts and verdicts."""
        return without_extras(judge(self.rows, self.pairs, self.domain, short=True))

    @property
    def verdicts(self) -> DataFrame:
        """Every aligned row with its field counts and verdicts. Texts are compared in their short form, so
        no long text is moved; the compared columns are left out."""
        rows = judge(self._aligned(self.prepared.short()), self.pairs, self.domain, short=True)
        compared = {c for p in self.pairs for c in (p.src, p.tgt)}
        return without_extras(rows).drop(*compared)

    @property
    def discrepancies(self) -> DataFrame:
        """Rows that do not match, with type, details, verdicts and the list of variances."""
        judged = judge(self.rows, self.pairs, self.domain)
        return without_extras(describe(judged.where(F.col("status") != verdict.MATCH), self.keys, self.pairs))

    @property
    def summary(self) -> DataFrame:
        """One row of counts and gates."""
        return summarize(self.verdicts, self.source, self.target, self.domain)

    @property
    def key_counts(self) -> DataFrame:
        """Rows and pairs per key, counted without joining."""
        return key_tally(self.prepared)

    @property
    def match_counts(self) -> DataFrame:
        """One row of totals, status counts and match percentage, counted without joining."""
        return count_statuses(self.key_counts, self.domain)

    def checkpointed(self) -> "Result":
        """The same result with the aligned rows written to the checkpoint folder.

        Worth it when both the summary and the discrepancies are wanted: the join then runs
        once, and a lost executor does not bring it back.
        """
        sc = self.rows.sparkSession.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_folder(self.rows.sparkSession))
        return replace(self, stored=self.rows.checkpoint())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; only a session on one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checked_folder(spark: SparkSession, folder: str) -> str:
    """A folder given by the caller, which must not be on one machine's own disk."""
    local = spark.sparkContext.master.startswith("local")
    if not local and (folder.startswith("file:") or "://" not in folder and _default_is_local(spark)):
        raise ValueError(f"{folder} is a local folder, which executors on other machines do not see")
    return folder


def _default_is_local(spark: SparkSession) -> bool:
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def without_extras(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def reconcile(
    source: DataFrame,
    target: DataFrame,
    domain: Domain,
    *,
    use_hash_column: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> Result:
    """Compare two relations as the domain says. Starts no job.

    `use_hash_column` trusts a stored hash instead of computing one. `hot_rows` is the number of
    rows from which a key is split over several tasks; None skips the search for such keys, which
    reads the key columns of both sides once more. The frames are the same either way.
    """
    contracts.require(source, target, domain, use_hash_column)
    p = prepare(source, target, domain, use_hash_column)
    return Result(domain, source, target, p, hot_rows=hot_rows)


def rare_discrepancies(
    source: DataFrame,
    target: DataFrame,
    domain: Domain,
    *,
    folder: str | None = None,
    use_hash_column: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The discrepancies, for wide rows that mostly match.

    Keys and hashes alone are aligned first, and the keys that do not match everywhere are written
    to the shared folder. Only rows of those keys then take part in the comparison of fields.
    Spark joins them by their number and written size: broadcast when small, shuffled otherwise. Costs a second
    read of both sides, and spares the shuffle of every matching row's fields. The written keys
    are read again by every action on the result; `clear_written` removes them when it is done with.
    """
    p, keys = _odd_keys(source, target, domain, folder, use_hash_column, hot_rows)
    q = replace(
        p, source=p.source.join(keys, p.keys, "left_semi"), target=p.target.join(keys, p.keys, "left_semi")
    )
    return Result(domain, source, target, q, hot_rows=hot_rows).discrepancies


def late_discrepancies(
    source: DataFrame,
    target: DataFrame,
    domain: Domain,
    *,
    folder: str | None = None,
    use_hash_column: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The discrepancies of sides that are projections or filters of Parquet scans, with values read at the very end.

    As in `rare_discrepancies` keys and hashes are aligned first. The keys that do not match everywhere then name the places of
    their rows, file and row number, which are written as bits; values are read from these places alone, whether few or many, and rows that
    match are never shuffled with their values. Sides without places are handled as in `rare_discrepancies`.
    `clear_written` removes what was written.
    """
    if located(source) is None or located(target) is None:
        return rare_discrepancies(source, target, domain, folder=folder, use_hash_column=use_hash_column, hot_rows=hot_rows)
    p, keys = _odd_keys(source, target, domain, folder, use_hash_column, hot_rows)
    places = prepare(located(source), located(target), domain, use_hash_column, carried=(FILE, ROW))

    def rows(side: DataFrame, own: DataFrame, null_key: DataFrame | None) -> DataFrame:
        found = own.select(*p.keys, FILE, ROW).join(keys, p.keys, "left_semi").select(FILE, ROW)
        loose = [] if null_key is None else [null_key.select(FILE, ROW)]
        return fetch(side, stored_copy(marks(reduce(DataFrame.unionAll, loose, found)), "odd-places", folder))

    q = prepare(rows(source, places.source, places.null_source), rows(target, places.target, places.null_target), domain, use_hash_column)
    return Result(domain, source, target, q, hot_rows=hot_rows).discrepancies


def _odd_keys(
    source: DataFrame, target: DataFrame, domain: Domain, folder: str | None, use_hash_column: bool, hot_rows: int | None
) -> tuple[Prepared, DataFrame]:
    """Both sides prepared, and the written keys that do not match everywhere."""
    contracts.require(source, target, domain, use_hash_column)
    p = prepare(source, target, domain, use_hash_column)
    odd = align(p.thin(), hot_rows).where((F.col("status") != verdict.MATCH) & ~has_null_key(p.keys))
    keys = stored_copy(odd.select(*p.keys).distinct(), "odd-keys", folder)
    # Spark takes files of some MB for small, but a million keys in them are not once the driver has unpacked them.
    return p, keys if keys.count() <= SENT_KEYS else keys.hint("merge")


def stored_copy(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    spark = df.sparkSession
    base = checked_folder(spark, folder) if folder else shared_folder(spark)
    path = f"{base}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Names of the folders that this library writes for a frame's own use.
WRITTEN = ("odd-keys", "odd-places", "odd-buckets", "digests", "listing")


def clear_written(df: DataFrame) -> None:
    """Delete what was written to make this frame."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[-1].rsplit("-", 5)[0] in WRITTEN:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def judge(rows: DataFrame, pairs: list[PairColumns], domain: Domain, short: bool = False) -> DataFrame:
    """Add per-pair variance columns (mismatches only), field counts and both verdicts.

    `short` compares texts by their short form instead of in full.
    """
    mismatch = F.col("status") == verdict.MISMATCH
    measured = {}
    for i, p in enumerate(pairs):
        (a, a_number), (b, b_number) = [pair_value(name, dtype, short) for name, dtype in p.sides()]
        measured[f"_same_{i}"] = F.when(mismatch, variance.same_text(a, p.src_type, b, p.tgt_type))
        measured[f"_null_{i}"] = F.when(mismatch, a.isNull().cast("int") + b.isNull().cast("int"))
        measured[f"_src_{i}"] = F.when(mismatch, a_number)
        measured[f"_tgt_{i}"] = F.when(mismatch, b_number)
    n = range(len(pairs))
    kinds = {
        f"_type_{i}": variance.variance_type(f"_null_{i}", f"_same_{i}", f"_src_{i}", f"_tgt_{i}") for i in n
    }
    pcts = {f"_pct_{i}": variance.variance_pct(f"_type_{i}", f"_src_{i}", f"_tgt_{i}") for i in n}
    total = len(pairs)
    return (
        rows.withColumns(measured)
        .withColumns(kinds)
        .withColumns(pcts)
        .withColumns(
            {
                "total_fields": F.when(mismatch, F.lit(total)).otherwise(0),
                "matching_fields": F.when(
                    mismatch, verdict.fields_within(list(pcts), domain.variance_threshold)
                ).otherwise(0),
                "excessive_fields": F.when(mismatch, verdict.fields_exceeding(list(pcts))).otherwise(0),
                "max_variance": F.when(mismatch, verdict.largest(list(pcts))),
            }
        )
        .withColumn("field_match_pct", verdict.field_match_pct("matching_fields", total))
        .withColumns(
            {"verdict": verdict.slo_verdict(domain.slo_target), "strict_verdict": verdict.strict_verdict(total)}
        )
    )


def pair_value(name: str, dtype: T.DataType, short: bool) -> tuple[Column, Column]:
    """A compared column, or its short form, and its number."""
    if short and isinstance(dtype, T.StringType):
        text = F.col(short_column(name))
        return text, variance.short_number(text, F.col(number_column(name)))
    return F.col(name), variance.as_number(F.col(name), dtype)


def describe(judged: DataFrame, keys: list[str], pairs: list[PairColumns]) -> DataFrame:
    """Add record id, discrepancy type, details and the variances as one list per row."""
    variances = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("field_name"),
                canon.raw_text(F.col(p.src), p.src_type).alias("source_value"),
                canon.raw_text(F.col(p.tgt), p.tgt_type).alias("target_value"),
                F.col(f"_pct_{i}").alias("variance_pct"),
                F.col(f"_type_{i}").alias("variance_type"),
            )
            for i, p in enumerate(pairs)
        ]
    )
    mismatch = F.col("status") == verdict.MISMATCH
    return judged.withColumns(
        {
            "record_id": record_id(keys),
            "discrepancy_type": verdict.lookup(F.col("status"), verdict.DISCREPANCY_TYPE),
            "details": verdict.lookup(F.col("status"), verdict.DETAILS),
            "variances": F.when(mismatch, variances).otherwise(F.filter(variances, lambda _: F.lit(False))),
        }
    )


def field_variances(discrepancies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per discrepancy and field."""
    return discrepancies.select(*keys, "copies", F.inline("variances"))
