"""The registered queries: one function per query, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import pairs
from concord import Domain, Enrichment, Field, Result, Side, hash_view, reconcile
from concord.functions import canon
from concord.operators import discrepancies as listing
from concord.operators import scope
from concord.operators.align import key_tally, one_sided
from concord.operators.enrich import enrich_side
from concord.operators.hashview import prepare
from concord.operators.records import field_names, get_field, record
from concord.plans import audit, contracts, report
from concord.plans.drilldown import Drilldown, drilldown
from concord.plans.listing import Listing, stored_listing
from concord.plans.many import summaries
from concord.plans.reconcile import field_variances, late_discrepancies, rare_discrepancies, shared_folder
from concord.plans.summary import breakdown, count_statuses, text_line
from concord.sources.relations import quantile_bounds, slice_predicates

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, sf_dir: str, **options) -> Result:
    return reconcile(
        pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain(**options)
    )


def _customers(spark: SparkSession, sf_dir: str, **options) -> Result:
    return reconcile(
        pairs.customers(spark, sf_dir), pairs.customers_copy(spark, sf_dir), pairs.customers_domain(**options)
    )


# Hashes and text forms


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_view(pairs.orders(spark, sf_dir), pairs.orders_domain().source).select("o_orderkey", "record_hash")


def record_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = hash_view(pairs.orders(spark, sf_dir), pairs.orders_domain().source, algorithm="sha256")
    return view.select("o_orderkey", "record_hash")


def record_hash_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = hash_view(
        pairs.orders(spark, sf_dir), pairs.orders_domain().source, profile="oracle", strip_zeros=True, ignore_case=True
    )
    return view.select("o_orderkey", "record_hash")


def _database_hash(profile: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        side = Side("orders", (Field("o_orderkey", "BIGINT"),), pairs.TYPED_FIELDS)
        return hash_view(pairs.typed_orders(spark, sf_dir), side, profile=profile).select("o_orderkey", "record_hash")

    return query


def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_view(pairs.documents(spark, sf_dir), pairs.documents_domain().source).select("doc_id", "record_hash")


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs.orders(spark, sf_dir).withColumn("ref", F.upper(F.md5("o_orderstatus")))
    types = {f.name: f.dataType for f in df.schema}

    def text(name: str, declared: str, **options):
        return canon.declared_text(df[name], types[name], Field(name, declared), **options)

    return df.select(
        "o_orderkey",
        text("o_custkey", "BIGINT").alias("integer_text"),
        text("price", "DECIMAL").alias("decimal_text"),
        text("price", "DECIMAL", strip_zeros=True).alias("short_decimal_text"),
        text("o_orderdate", "TIMESTAMP").alias("timestamp_text"),
        text("o_orderdate", "DATE").alias("date_text"),
        text("o_orderdate", "DATE", profile="oracle").alias("oracle_date_text"),
        text("ref", "UUID").alias("uuid_text"),
    )


# Alignment


def aligned_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).statuses.select("k_1", "src_hash", "tgt_hash", "status", "copies")


def precomputed_hash_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    src = pairs.orders(spark, sf_dir).withColumn(
        "record_hash", F.when(key % 30 != 1, F.md5(F.concat_ws("|", "o_custkey", "o_orderstatus")))
    )
    tgt = pairs.orders_copy(spark, sf_dir).withColumn(
        "_record_hash", F.when(key % 15 != 1, F.md5(F.concat_ws("|", "o_custkey", "o_orderstatus")))
    )
    r = reconcile(src, tgt, pairs.orders_domain(), use_hash_column=True)
    return r.verdicts.select("k_1", "src_hash", "tgt_hash", "status", "verdict", "strict_verdict", "copies")


def composite_key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reconcile(
        pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain()
    )
    return r.statuses.groupBy("k_1", "k_2", "status").agg(F.sum("copies").alias("pairs"))


def composite_key_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_tally(
        prepare(pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain())
    )


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepare(pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain())
    return count_statuses(key_tally(p), pairs.lineitems_domain())


def composite_key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(
        pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain()
    ).summary


def cross_type_key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _customers(spark, sf_dir)
    return r.aligned.select("k_1", "src_c_acctbal", "tgt_balance", "status", "copies")


def null_key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def without(df: DataFrame, status: str) -> DataFrame:
        return df.withColumn("o_orderkey", F.when(F.col("o_orderstatus") != status, F.col("o_orderkey")))

    r = reconcile(
        without(pairs.orders(spark, sf_dir), "P"),
        without(pairs.orders_copy(spark, sf_dir), "O"),
        pairs.orders_domain(),
    )
    return r.statuses.select("k_1", "src_present", "tgt_present", "src_hash", "tgt_hash", "status", "copies")


def missing_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = one_sided(
        prepare(pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain())
    )
    return src.select("k_1", F.lit("MISSING_IN_TARGET").alias("discrepancy_type")).unionAll(
        tgt.select("k_1", F.lit("MISSING_IN_SOURCE").alias("discrepancy_type"))
    )


# Digests of buckets, and values read late


def _digest_orders(spark: SparkSession, sf_dir: str) -> Drilldown:
    return drilldown(pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain(), unique_keys=True)


def _digest_lines(spark: SparkSession, sf_dir: str) -> Drilldown:
    return drilldown(pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain())


def digest_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_lines(spark, sf_dir).match_counts


def digest_line_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_lines(spark, sf_dir).statuses.groupBy("k_1", "k_2", "status").agg(F.sum("copies").alias("pairs"))


def digest_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_orders(spark, sf_dir).match_counts


def digest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = _digest_orders(spark, sf_dir).one_sided
    return src.select("k_1", F.lit("MISSING_IN_TARGET").alias("discrepancy_type")).unionAll(
        tgt.select("k_1", F.lit("MISSING_IN_SOURCE").alias("discrepancy_type"))
    )


def _late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_discrepancies(pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain())


def late_field_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_variances(_late_orders(spark, sf_dir), ["k_1"])


def late_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.descriptions(_late_orders(spark, sf_dir)).select(
        "record_id", "src_hash", "tgt_hash", "discrepancy_type", "type_description", "details",
        "verdict", "verdict_description", "copies",
    )


def late_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the documents that differ, by their length and digest."""
    found = late_discrepancies(pairs.documents(spark, sf_dir), pairs.documents_copy(spark, sf_dir), pairs.documents_domain())
    return found.select("k_1", "status", F.md5("src_text").alias("src_text_md5"), F.md5("tgt_text").alias("tgt_text_md5"), "verdict", "copies")


def _enriched(how: str) -> Query:
    """Every order with the segment of its customer; orders of one customer in ten name none."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        joins = (Enrichment("customer", "o_custkey", "c_custkey", how, ("c_mktsegment",)),)
        side = Side(
            "orders", (Field("o_orderkey", "BIGINT"),), (*pairs.ORDER_FIELDS, Field("c_mktsegment")), joins=joins
        )

        def customers(_: str) -> DataFrame:
            return pairs.customers(spark, sf_dir)

        def renumbered(orders: DataFrame) -> DataFrame:
            key = F.col("o_custkey")
            return orders.withColumn("o_custkey", F.when(key % 10 == 3, -key).otherwise(key))

        r = reconcile(
            enrich_side(renumbered(pairs.orders(spark, sf_dir)), side, customers),
            enrich_side(renumbered(pairs.orders_copy(spark, sf_dir)), side, customers),
            Domain(f"enriched-{how}", side, side),
        )
        return r.aligned.select("k_1", "src_c_mktsegment", "tgt_c_mktsegment", "src_hash", "tgt_hash", "status", "copies")

    return query


def order_vs_lineitem_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = (
        pairs.lineitems(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("price").cast(pairs.MONEY).alias("total"))
    )
    domain = Domain(
        "order-totals",
        Side("orders", (Field("o_orderkey", "BIGINT"),), (Field("price", "DECIMAL"),)),
        Side("lineitem", (Field("l_orderkey", "BIGINT"),), (Field("total", "DECIMAL"),)),
    )
    r = reconcile(pairs.orders(spark, sf_dir), totals, domain)
    return r.judged.select(
        "k_1", F.col("src_price").alias("order_price"), F.col("tgt_total").alias("lines_price"),
        "status", "max_variance", "verdict", "copies",
    )


def name_mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs.customers_domain()
    shuffled = Side(d.target.table, d.target.id_fields, tuple(reversed(d.target.hash_fields)))
    mapping = {"c_name": "full_name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}
    domain = Domain("mapped", d.source, shuffled, field_mappings=mapping)
    r = reconcile(pairs.customers(spark, sf_dir), pairs.customers_copy(spark, sf_dir), domain)
    return r.statuses.select("k_1", "src_hash", "tgt_hash", "status", "copies")


def case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, ignore_case=True).statuses.select("k_1", "src_hash", "tgt_hash", "status", "copies")


def date_vs_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (Field("ship", "DATE"),)
    domain = Domain(
        "ship-dates",
        Side("lineitem", (Field("l_orderkey", "BIGINT"),), fields),
        Side("orders", (Field("o_orderkey", "BIGINT"),), (Field("ship", "TIMESTAMP"),)),
    )
    first = (
        pairs.table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_shipdate").cast("date").alias("ship"))
    )
    orders = pairs.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ship"))
    return reconcile(first, orders, domain).statuses.select("k_1", "src_hash", "tgt_hash", "status", "copies")


# Exact numbers and odd words


def _numbers(make: Callable[[DataFrame], DataFrame], change: Callable[[Column], Column], declared: str) -> Query:
    """Orders with one number each, against a copy in which one in 20 is off by the least step."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = make(pairs.orders(spark, sf_dir)).select("o_orderkey", "x")
        tgt = src.withColumn("x", F.when(F.col("o_orderkey") % 20 == 3, change(F.col("x"))).otherwise(F.col("x")))
        side = Side("orders", (Field("o_orderkey", "BIGINT"),), (Field("x", declared),))
        return reconcile(src, tgt, Domain("numbers", side, side)).verdicts.select("k_1", "status", "verdict", "copies")

    return query


def float_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    src = pairs.orders(spark, sf_dir).select((key * F.lit("0.00001").cast("decimal(6,5)")).cast("decimal(20,5)").alias("ref"), "o_orderstatus")
    tgt = pairs.orders_copy(spark, sf_dir).select((key.cast("double") / 100000.0).alias("ref"), "o_orderstatus")
    side = Side("orders", (Field("ref", "NUMERIC"),), (Field("o_orderstatus"),))
    return reconcile(src, tgt, Domain("float-keys", side, side)).statuses.select("k_1", "status", "copies")


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("o_orderkey") % 7
    word = F.coalesce(*[F.when(rule == i, w) for i, w in enumerate(("12", "INF", "nan", "NaN", "Infinity", "0x1p3", "12 x"))])
    side = Side("orders", (Field("o_orderkey", "BIGINT"),), (Field("word"),))
    src = pairs.orders(spark, sf_dir).select("o_orderkey", F.lit("12").alias("word"))
    tgt = pairs.orders(spark, sf_dir).select("o_orderkey", word.alias("word"))
    found = reconcile(src, tgt, Domain("words", side, side)).discrepancies
    return found.select("k_1", F.col("variances")[0]["variance_type"].alias("variance_type"), "verdict", "strict_verdict", "copies")


# Repeated keys that are split over tasks


def _by_order(spark: SparkSession, sf_dir: str) -> Result:
    """Line items by order alone: up to several lines a key on both sides, split from three on."""
    side = Side("lineitem", (Field("l_orderkey", "BIGINT"),), pairs.lineitems_domain().source.hash_fields)
    return reconcile(
        pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), Domain("by-order", side, side), hot_rows=3
    )


def hot_key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_order(spark, sf_dir).statuses.groupBy("k_1", "status").agg(F.sum("copies").alias("pairs"))


def hot_key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_order(spark, sf_dir).summary


# Variance and verdicts


def order_field_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir)
    return field_variances(r.discrepancies, r.keys)


def _verdicts(**options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir, **options).discrepancies.select(
            "k_1", "status", "matching_fields", "total_fields", "field_match_pct",
            "excessive_fields", "max_variance", "verdict", "strict_verdict", "copies",
        )

    return query


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reconcile(
        pairs.documents(spark, sf_dir), pairs.documents_copy(spark, sf_dir), pairs.documents_domain()
    )
    return r.verdicts.select("k_1", "status", "matching_fields", "max_variance", "verdict", "strict_verdict", "copies")


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir)
    return r.aligned.withColumn("rec", record(r.keys, r.pairs, "target")).select(
        "k_1",
        F.col("rec.id").alias("id"),
        F.col("rec.record_hash").alias("record_hash"),
        F.col("rec.side").alias("side"),
        get_field("rec", "price").alias("price"),
        get_field("rec", "o_orderstatus").alias("o_orderstatus"),
        F.array_join(F.array_sort(field_names("rec")), ",").alias("field_names"),
        "copies",
    )


# Summaries


def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).summary


def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_orders(spark, sf_dir).statuses, "status")


def verdict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_orders(spark, sf_dir).verdicts, "verdict")


def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.by_type(_orders(spark, sf_dir).discrepancies)


def multi_domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(
        [
            (pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain()),
            (pairs.customers(spark, sf_dir), pairs.customers_copy(spark, sf_dir), pairs.customers_domain()),
            (pairs.documents(spark, sf_dir), pairs.documents_copy(spark, sf_dir), pairs.documents_domain()),
        ]
    )


def multi_domain_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with keys of one and two fields and with thresholds of their own."""
    return summaries(
        [
            (pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain(slo_target=75.0)),
            (pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain("strict", slo_target=99.0, variance_threshold=0.4)),
            (pairs.lineitems(spark, sf_dir), pairs.lineitems_copy(spark, sf_dir), pairs.lineitems_domain()),
        ]
    )


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).summary.select(
        "domain", text_line().alias("summary_line")
    )


# Discrepancy lists


def _listed(pick: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pick(_orders(spark, sf_dir).discrepancies)
        return rows.select("k_1", "discrepancy_type", "details", "max_variance", "strict_verdict", "copies")

    return query


def discrepancy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.descriptions(_orders(spark, sf_dir).discrepancies).select(
        "record_id", "src_hash", "tgt_hash", "discrepancy_type", "type_description", "details",
        "verdict", "verdict_description", "copies",
    )


def rare_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rare_discrepancies(pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), pairs.orders_domain())
    return found.select("k_1", "discrepancy_type", "details", "max_variance", "strict_verdict", "copies")


def discrepancy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, read again: types, ids and hashes of both records, and the number of variances."""
    text = report.discrepancy_json(_orders(spark, sf_dir))

    def at(path: str) -> Column:
        return F.get_json_object("discrepancy", f"$.{path}")

    return text.select(
        at("discrepancyType").alias("discrepancy_type"),
        at("verdict").alias("verdict"),
        at("details").alias("details"),
        at("sourceRecord.id").alias("source_id"),
        at("sourceRecord.recordHash").alias("source_hash"),
        at("targetRecord.id").alias("target_id"),
        at("targetRecord.recordHash").alias("target_hash"),
        at("copies").cast("bigint").alias("copies"),
    )


def discrepancy_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir).discrepancies
    last = listing.page(found, 100).collect()[-1]  # the line the reader has come to
    return listing.page(found, 100, last).select("k_1", "status", "discrepancy_type", "copies")


def discrepancy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(_orders(spark, sf_dir).discrepancies, 100).select(
        "k_1", "status", "discrepancy_type", "copies"
    )


def _stored_listing(spark: SparkSession, sf_dir: str) -> Listing:
    return stored_listing(_orders(spark, sf_dir).discrepancies, file_lines=1_000)


def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_listing(spark, sf_dir).page(100).select("k_1", "status", "discrepancy_type", "copies")


def listing_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_listing(spark, sf_dir)
    return stored.page(100, stored.page(100).collect()[-1]).select("k_1", "status", "discrepancy_type", "copies")


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV export, read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    report.write_csv(_orders(spark, sf_dir).discrepancies, path)
    return spark.read.option("header", True).schema("discrepancy_type string, record_id string, details string, copies long").csv(path)


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a registered list."""
    name = f"listed_{uuid.uuid4().hex}"
    report.register(_orders(spark, sf_dir).discrepancies, name)
    return spark.sql(f"SELECT discrepancy_type, strict_verdict, sum(copies) AS records, max(max_variance) AS largest FROM {name} GROUP BY ALL")


# Runs


def run_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over whole tables, the first of them logged twice: orders with their copy, with themselves, with the copy again."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4()}"
    source, target = pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir)
    for run_id, other in (("1", target), ("1", target), ("2", source), ("3", target)):
        report.append_run(reconcile(source, other, pairs.orders_domain()).summary, path, run_id)
    return report.run_trend(report.read_runs(spark, path), "run_id")


def empty_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No order has such a status."""
    src, tgt = (df.where("o_orderstatus = 'none'") for df in (pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir)))
    return reconcile(src, tgt, pairs.orders_domain()).summary


# Scope


def _scoped(field: str | tuple[str, str], restrict: Callable[[DataFrame, str], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        domain = pairs.orders_domain()
        src, tgt = scope.both_sides(
            pairs.orders(spark, sf_dir), pairs.orders_copy(spark, sf_dir), domain, field, restrict
        )
        r = reconcile(src, tgt, domain)
        return r.statuses.select("k_1", "src_hash", "tgt_hash", "status", "copies")

    return query


# Contracts


def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.key_audit(pairs.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def audit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items audited flag by flag, one flag twice; beside the exact number of keys."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4()}"
    rows, keys = pairs.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    for part in (F.col("l_returnflag") == "R", F.lit(True)):
        audit.store_parts(audit.audit_parts(rows.where(part), keys, [], F.col("l_returnflag")), path)
    exact = rows.select(*keys).distinct().agg(F.count("*").alias("exact"))
    stacked = audit.merged_keys(spark.read.parquet(path)).unionByName(exact, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in ("row_count", "null_keys", "distinct_keys", "exact")])
    return one.select("row_count", "null_keys", (F.abs(F.col("distinct_keys") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


def audit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4()}"
    rows, fields = _typed_events(spark, sf_dir)
    audit.store_parts(audit.audit_parts(rows, ["event_id"], fields, F.col("event_type")), path)
    return audit.merged_fields(spark.read.parquet(path)).select("field_name", "declared_type", "present", "nonconforming")


def value_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fields = _typed_events(spark, sf_dir)
    return audit.offenders(rows, fields[:5], 3)


def _slices(table: str, key: str, column: str, count: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows and keys over the slices of a column, and whether none is larger than twice its share."""
        rows = pairs.table(spark, sf_dir, table)
        slices = slice_predicates(column, quantile_bounds(rows, column, count))
        numbered = F.coalesce(*[F.when(F.expr(s), F.lit(i)) for i, s in enumerate(slices)])
        sizes = rows.groupBy(numbered.alias("slice")).agg(F.count("*").alias("n"), F.sum(key).alias("keys"))
        fair = F.max("n") <= 2 * F.sum("n") / count
        return sizes.where("slice IS NOT NULL").agg(F.sum("n").alias("row_count"), F.sum("keys").alias("key_sum"), fair.alias("fair"))

    return query


def type_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.type_conformance(*_typed_events(spark, sf_dir))


def _typed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Field]]:
    digest = F.md5(F.col("event_id").cast("string"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    df = pairs.table(spark, sf_dir, "events").withColumns(
        {
            "k": F.get_json_object("props", "$.k"),
            "ref": F.when(F.col("event_id") % 3 == 0, F.concat_ws("-", *parts)).otherwise(digest),
            "amount": F.col("value").cast("string"),
        }
    )
    fields = [
        Field("k", "INT"), Field("event_type", "DECIMAL"), Field("event_id", "SMALLINT"),
        Field("props", "DATE"), Field("ref", "UUID"), Field("event_type", "STRING"),
        Field("amount", "DECIMAL", precision=4, scale=2),
    ]
    return df, fields


QUERIES: dict[str, Query] = {
    "recon_summary": recon_summary,
    "record_hash": record_hash,
    "record_hash_sha256": record_hash_sha256,
    "record_hash_oracle": record_hash_oracle,
    "record_hash_mysql": _database_hash("mysql"),
    "record_hash_sqlserver": _database_hash("sqlserver"),
    "record_hash_postgres": _database_hash("postgres"),
    "document_hash": document_hash,
    "canonical_text": canonical_text,
    "aligned_status": aligned_status,
    "precomputed_hash_status": precomputed_hash_status,
    "composite_key_status": composite_key_status,
    "composite_key_tally": composite_key_tally,
    "composite_key_summary": composite_key_summary,
    "match_counts": match_counts,
    "cross_type_key_status": cross_type_key_status,
    "null_key_status": null_key_status,
    "missing_either_way": missing_either_way,
    "digest_drilldown": digest_drilldown,
    "digest_line_statuses": digest_line_statuses,
    "digest_unique_counts": digest_unique_counts,
    "digest_missing": digest_missing,
    "late_field_variances": late_field_variances,
    "late_report": late_report,
    "late_documents": late_documents,
    "enriched_left": _enriched("left"),
    "enriched_inner": _enriched("inner"),
    "order_vs_lineitem_total": order_vs_lineitem_total,
    "name_mapped_pairs": name_mapped_pairs,
    "case_insensitive": case_insensitive,
    "date_vs_timestamp": date_vs_timestamp,
    "small_decimals": _numbers(
        lambda df: df.withColumn("x", (F.col("price") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,8)")),
        lambda x: (x + F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(20,8)"),
        "DECIMAL",
    ),
    "double_values": _numbers(
        lambda df: df.withColumn("x", F.col("price").cast("double") / 1e6), lambda x: x * (1 + 2.0**-52), "DOUBLE"
    ),
    "float_keys": float_keys,
    "number_words": number_words,
    "hot_key_status": hot_key_status,
    "hot_key_summary": hot_key_summary,
    "field_variances": order_field_variances,
    "verdicts": _verdicts(),
    "verdicts_loose": _verdicts(slo_target=75.0),
    "verdicts_strict": _verdicts(slo_target=99.0, variance_threshold=0.4),
    "document_verdicts": document_verdicts,
    "record_fields": record_fields,
    "status_breakdown": status_breakdown,
    "verdict_breakdown": verdict_breakdown,
    "type_breakdown": type_breakdown,
    "multi_domain_summary": multi_domain_summary,
    "multi_domain_strict": multi_domain_strict,
    "summary_text": summary_text,
    "material_only": _listed(listing.material),
    "noisy_only": _listed(listing.noisy),
    "missing_in_target": _listed(lambda d: listing.of_type(d, "MISSING_IN_TARGET")),
    "missing_in_source": _listed(lambda d: listing.of_type(d, "MISSING_IN_SOURCE")),
    "high_variance": _listed(lambda d: listing.high_variance(d, 5.0)),
    "discrepancy_report": discrepancy_report,
    "rare_discrepancies": rare_lists,
    "discrepancy_json": discrepancy_json,
    "discrepancy_page": discrepancy_page,
    "discrepancy_second_page": discrepancy_second_page,
    "scope_period": _scoped("o_orderdate", lambda df, c: scope.period(df, c, "1996-09-17")),
    "scope_entity": _scoped("o_custkey", lambda df, c: scope.entity(df, c, 605)),
    "scope_other_column": _scoped(("o_orderstatus", "o_orderstatus"), lambda df, c: scope.entity(df, c, "F")),
    "scope_range": _scoped("o_orderdate", lambda df, c: scope.date_range(df, c, "1996-01-01", "1997-12-31")),
    "listing_page": listing_page,
    "listing_second_page": listing_second_page,
    "csv_lines": csv_lines,
    "view_counts": view_counts,
    "run_trend": run_trend,
    "empty_sides": empty_sides,
    "key_audit": key_audit,
    "type_conformance": type_conformance,
    "audit_keys": audit_keys,
    "audit_fields": audit_fields,
    "value_offenders": value_offenders,
    "slices_by_price": _slices("orders", "o_orderkey", "o_totalprice", 16),
    "slices_by_length": _slices("documents", "doc_id", "n_chars", 16),
}
