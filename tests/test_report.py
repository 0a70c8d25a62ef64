"""Reports, paging and sinks, written and read back."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concord import reconcile
from concord.operators import discrepancies as listing
from concord.operators import records
from concord.plans import report, summary
from helpers import domain, frame

SRC = [(1, Decimal("100.00"), "a"), (2, Decimal("100.00"), "b"), (3, Decimal("1.00"), "c"), (5, Decimal("1.00"), "e")]
TGT = [(1, Decimal("100.50"), "a"), (2, Decimal("150.00"), "b"), (4, Decimal("1.00"), "d"), (5, Decimal("1.00"), "e")]


@pytest.fixture(scope="module")
def result(spark):
    return reconcile(frame(spark, SRC), frame(spark, TGT), domain("report"))


def test_json_shape(result):
    rows = [json.loads(r[0]) for r in report.discrepancy_json(result).collect()]
    by_id = {(r["sourceRecord"] or r["targetRecord"])["id"]: r for r in rows}
    assert set(by_id) == {"1", "2", "3", "4"}
    one = by_id["1"]
    assert one["discrepancyType"] == "HASH_MISMATCH" and one["verdict"] == "NOISY"
    assert one["sourceRecord"]["source"] == "source" and one["targetRecord"]["source"] == "target"
    assert one["sourceRecord"]["fields"] == {"amount": "100.00", "note": "a"}
    amount = one["fieldVariances"][0]
    assert amount == {
        "fieldName": "amount", "sourceValue": "100.00", "targetValue": "100.50",
        "variancePercentage": 0.5, "varianceType": "NUMERIC",
    }
    assert by_id["3"]["targetRecord"] is None and by_id["3"]["fieldVariances"] == []
    assert by_id["3"]["discrepancyType"] == "MISSING_IN_TARGET" and by_id["3"]["verdict"] == "MATERIAL"
    assert by_id["4"]["details"] == "Record exists only in target"


def test_json_and_csv_files(spark, result, tmp_path):
    report.write_json(result, f"{tmp_path}/json")
    line = json.loads(spark.read.text(f"{tmp_path}/json/summary").first()[0])
    assert line["domain"] == "report" and line["matchedRecords"] == 1 and line["matchPercentage"] == 25.0
    assert spark.read.json(f"{tmp_path}/json/discrepancies").count() == 4
    report.write_csv(result.discrepancies, f"{tmp_path}/csv")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert rows.columns == ["discrepancy_type", "record_id", "details", "copies"] and rows.count() == 4


def test_run_log(spark, result, tmp_path):
    for run_id in ("2024-01-01", "2024-01-02", "2024-01-02"):  # the last is a repetition
        report.append_run(result.summary, f"{tmp_path}/runs", run_id)
    trend = report.run_trend(report.read_runs(spark, f"{tmp_path}/runs")).orderBy("run").collect()
    assert [(r.run_id, r.run, r.match_change, r.discrepancy_change) for r in trend] == [("2024-01-01", 1, None, None), ("2024-01-02", 2, 0.0, 0)]
    with pytest.raises(ValueError):
        report.append_run(result.summary, f"{tmp_path}/runs", "")
    runs = report.read_runs(spark, f"{tmp_path}/runs").where("domain = 'report'")
    assert runs.count() == 2 and runs.where("executed_at IS NULL").isEmpty()


def test_views(spark, result):
    report.register(result.discrepancies, "my_discrepancies")
    n = spark.sql("SELECT count(*) FROM my_discrepancies WHERE discrepancy_type = 'HASH_MISMATCH'").first()[0]
    assert n == 2


def test_filters(result):
    d = result.discrepancies
    ids = lambda df: sorted(r["record_id"] for r in df.collect())
    assert ids(listing.material(d)) == ["2", "3", "4"]
    assert ids(listing.noisy(d)) == ["1"]
    assert ids(listing.of_type(d, "MISSING_IN_SOURCE")) == ["4"]
    assert ids(listing.high_variance(d)) == ["2"]
    assert listing.hashes(d).columns == ["record_id", "src_hash", "tgt_hash", "copies"]
    with pytest.raises(ValueError):
        listing.of_type(d, "SOURCE_ONLY")


def pages(df, size):
    out, last = [], None
    while True:
        rows = listing.page(df, size, last).collect()
        if not rows:
            return out
        assert len(rows) <= size
        out += rows
        last = rows[-1]


@pytest.mark.parametrize("size", [2, 100])
def test_pages_hold_everything(spark, size):
    src = [*SRC, (None, Decimal(1), "x"), (None, Decimal(1), "x"), (2, Decimal("100.00"), "z"), (2, Decimal("100.00"), "z")]
    d = reconcile(frame(spark, src), frame(spark, TGT), domain()).discrepancies
    got = pages(d, size)
    assert sum(r["copies"] for r in got) == d.agg(F.sum("copies")).first()[0]
    keys = [r["k_1"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len(got) == len({(r["k_1"], r["status"], r["src_hash"], r["tgt_hash"]) for r in got})


def test_summary_texts_and_maps(result):
    row = result.summary.select(
        summary.text_line().alias("line"),
        summary.record_breakdown().alias("records"),
        summary.verdict_breakdown().alias("verdicts"),
        summary.verdict_count("MATERIAL").alias("material"),
    ).first()
    assert row["line"] == "Reconciliation: 1/4 matched (25.0%), 1 pristine, 1 noisy, 3 material"
    assert row["records"] == {"matched": 1, "mismatched": 2, "sourceOnly": 1, "targetOnly": 1}
    assert row["verdicts"] == {"PRISTINE": 1, "NOISY": 1, "MATERIAL": 3} and row["material"] == 3
    with pytest.raises(ValueError):
        summary.verdict_count("FINE")


def test_records(result):
    df = result.aligned.select(
        "k_1",
        records.record(result.keys, result.pairs, "source").alias("s"),
        records.record(result.keys, result.pairs, "target").alias("t"),
    )
    rows = {
        r["k_1"]: r
        for r in df.select(
            "k_1",
            records.get_field("s", "note").alias("note"),
            records.get_field("s", "absent").alias("absent"),
            records.has_field("s", "amount").alias("has"),
            records.has_field("s", "absent").alias("has_not"),
            records.field_names("s").alias("names"),
            records.with_fields("s", {"x": "1"}).alias("replaced"),
            records.same_record("s", "t").alias("same"),
        ).collect()
    }
    assert rows[1]["note"] == "a" and rows[1]["absent"] is None and rows[1]["has"] and not rows[1]["has_not"]
    assert rows[1]["names"] == ["amount", "note"] and rows[1]["replaced"]["fields"] == {"x": "1"}
    assert rows[5]["same"] and not rows[1]["same"]
    twice = df.where("s IS NOT NULL").unionByName(df.where("s IS NOT NULL"))
    assert records.distinct_records(twice, "s").count() == 4
