import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaykit import HistoryStore, load_csv, session, transform
from assaykit.__main__ import main
from assaykit.operators import marts
from assaykit.operators.transform import (
    TransformationError, from_snapshot, require_transformable, to_snapshot)
from assaykit.plans import jobs
from assaykit.sources.sinks import replace_database_table
from assaykit.sources.store import IntegrityError
from conftest import COLUMNS, NAMES

ROWS = [["536365", "85123A", "HEART", "6", "12/1/2010 8:26", "2.5", "17850.0", "United Kingdom"],
        ["C536366", "71053", "LANTERN", "-2", "12/1/2010 8:28", "3.0", "17850.0", "United Kingdom"]]


@pytest.fixture
def csv(tmp_path):
    def write(changes=None, rows=ROWS):
        rows = [list(r) for r in rows]
        for column, value in (changes or {}).items():
            rows[0][NAMES.index(column)] = value
        path = tmp_path / "retail.csv"
        path.write_text("\n".join(",".join(r) for r in [NAMES, *rows]) + "\n")
        return str(path)
    return write


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_transform_is_lossless(spark, csv):
    rows = transform(load_csv(spark, csv())).orderBy(F.desc("Revenue")).collect()
    assert [r.InvoiceDate for r in rows] == ["2010-12-01T08:26:00", "2010-12-01T08:28:00"]
    assert [r.IsCancellation for r in rows] == [False, True]
    assert [r.Revenue for r in rows] == [15.0, -6.0]


@pytest.mark.parametrize("change, message", [
    ({"InvoiceDate": "not-a-date"}, "InvoiceDate contains 1 unparseable non-null value"),
    ({"Quantity": "six"}, "Unable to normalize numeric fields")])
def test_transform_refuses_bad_values(spark, csv, change, message):
    with pytest.raises(TransformationError, match=message):
        require_transformable(load_csv(spark, csv(change)))


def test_transform_needs_its_columns(table, clean_rows):
    with pytest.raises(TransformationError, match="InvoiceDate"):
        transform(table(clean_rows).drop("InvoiceDate"))
    with pytest.raises(ValueError, match="Revenue"):
        to_snapshot(transform(table(clean_rows)).drop("Revenue"))


def test_transform_keeps_nulls_and_copies(table, sale):
    rows = [sale, sale, {**sale, "InvoiceDate": None, "InvoiceNo": None, "Quantity": None}]
    out = transform(table(rows))
    assert out.count() == 3
    odd = out.filter("InvoiceNo is null").first()
    assert (odd.IsCancellation, odd.Revenue, odd.InvoiceDate) == (False, None, None)


def test_snapshot_round_trip(table, clean_rows):
    out = transform(table(clean_rows))
    back = from_snapshot(to_snapshot(out), dict(out.dtypes)).select(*out.columns)
    assert back.dtypes == out.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect()))


def test_etl(spark, csv, root):
    result = jobs.run_etl(spark, csv(), root)
    assert (result.status, result.error_stage, result.run_id) == ("SUCCESS", None, 1)
    assert result.rows_extracted == result.rows_transformed == result.rows_loaded == 2
    store = HistoryStore(spark, root)
    rows = store.snapshot().orderBy("transaction_id").collect()
    assert len(rows) == 2 and len({r.transaction_id for r in rows}) == 2
    assert rows[0].invoice_date.isoformat() == "2010-12-01T08:26:00"
    assert store.results().count() == 18
    assert {r.stage: r.rows for r in store.lineage().collect()} == {"extraction": 2, "transformation": 2, "load": 2}
    path = store.lineage().filter("stage = 'load'").first().path
    sidecar = json.loads(spark.read.text(f"{path}.lineage.json").first().value)
    assert sidecar["load"]["output_path"] == path and sidecar["extraction"]["rows_extracted"] == 2


def test_quality_findings_do_not_fail_a_run(spark, csv, root):
    result = jobs.run_etl(spark, csv({"UnitPrice": "-2.0"}), root)
    assert (result.status, result.quality_failures) == ("SUCCESS", 1)
    assert result.rows_extracted == result.rows_transformed == result.rows_loaded == 2


def test_failures_name_their_stage(spark, csv, root, tmp_path):
    assert jobs.run_etl(spark, str(tmp_path / "absent.csv"), root).error_stage == "EXTRACT"
    bad_date = jobs.run_etl(spark, csv({"InvoiceDate": "bad-date"}), root)
    assert (bad_date.status, bad_date.error_stage, bad_date.rows_extracted) == ("FAILED", "TRANSFORM", 2)
    assert "1 unparseable" in bad_date.error_message
    assert jobs.run_etl(spark, csv({"Quantity": "six"}), root).error_stage == "TRANSFORM"
    assert jobs.run_etl(spark, csv(), "no-such-scheme://place").error_stage == "LOAD"
    null_price = jobs.run_etl(spark, csv({"UnitPrice": ""}), root)
    assert (null_price.error_stage, null_price.rows_transformed) == ("LOAD", 2)
    assert "unit_price" in null_price.error_message


@pytest.mark.parametrize("stage, target", [("VALIDATE", "run_isolated"), ("SCORE", "score"), ("PERSIST", "stamp")])
def test_late_failure_keeps_the_old_snapshot(spark, csv, root, monkeypatch, stage, target):
    assert jobs.run_etl(spark, csv(), root).status == "SUCCESS"

    def fail(*args, **kwargs):
        raise RuntimeError("stopped")

    monkeypatch.setattr(jobs, target, fail)
    result = jobs.run_etl(spark, csv({"Quantity": "600"}), root)
    assert (result.status, result.error_stage, result.error_message) == ("FAILED", stage, "stopped")
    store = HistoryStore(spark, root)
    assert store.runs().count() == 1 and store.snapshot().agg(F.max("quantity")).first()[0] == 6.0


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith("."))


@pytest.mark.parametrize("target", ["run_isolated", "score", "stamp", "summary", "write_lineage_sidecar"])
def test_a_failed_run_leaves_nothing(spark, csv, root, monkeypatch, target):
    assert jobs.run_etl(spark, csv(), root).status == "SUCCESS"
    before = files_below(root)
    assert not any("_staged" in f for f in before)
    monkeypatch.setattr(jobs, target, lambda *args, **kwargs: 1 / 0)
    assert jobs.run_etl(spark, csv({"Quantity": "600"}), root).status == "FAILED"
    assert jobs.run_etl(spark, csv({"UnitPrice": ""}), root).error_stage == "LOAD"
    assert files_below(root) == before


def test_a_failed_commit_leaves_nothing(spark, csv, root, monkeypatch):
    assert jobs.run_etl(spark, csv(), root).status == "SUCCESS"
    before = files_below(root)
    write = HistoryStore._write

    def stop(self, rows, name, attempt, runs):
        write(self, rows, name, attempt, runs)
        if name == "runs":
            raise RuntimeError("stopped")
    monkeypatch.setattr(HistoryStore, "_write", stop)
    assert jobs.run_etl(spark, csv(), root).error_stage == "PERSIST"
    assert files_below(root) == before


def test_working_folders_are_empty_afterwards(spark, csv, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "workspace", lambda spark, name: f"{shared}/{name}-{uuid.uuid4().hex}")
    for job in (jobs.profile_job, jobs.validate_job, jobs.score_job):
        job(spark, csv(), str(tmp_path / "report.json"), row_key="exact")
        assert shared.exists() and files_below(shared) == []
    monkeypatch.setattr(jobs, "write_json", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.profile_job(spark, csv(), str(tmp_path / "report.json"))
    assert files_below(shared) == []


def test_new_snapshot_replaces_the_old_one(spark, csv, root):
    jobs.run_etl(spark, csv(), root)
    result = jobs.run_etl(spark, csv(rows=ROWS[:1]), root)
    store = HistoryStore(spark, root)
    assert result.run_id == 2 and store.snapshot().count() == 1 and store.runs().count() == 2
    assert store.remove_old_snapshots() == 1 and store.snapshot().count() == 1
    assert store.remove_old_snapshots() == 0


def test_no_snapshot_yet(spark, root):
    with pytest.raises(FileNotFoundError):
        HistoryStore(spark, root).create().snapshot()


def test_lost_rows_are_noticed(spark, csv, root):
    store = HistoryStore(spark, root).create()
    path = store.snapshot_path(1)
    counts = store.stage_snapshot(transform(load_csv(spark, csv())), path)
    with pytest.raises(IntegrityError, match="expected 3, loaded 2"):
        store.verify_snapshot(path, {**counts, "rows_loaded": 3})


def test_further_columns_are_checked_but_not_stored(spark, table, clean_rows, root):
    df = table(clean_rows).withColumn("Channel", F.lit(None).cast("string"))
    result = jobs.run_etl(spark, df, root)
    store = HistoryStore(spark, root)
    assert result.status == "SUCCESS" and "Channel" not in store.snapshot().columns
    assert store.results().filter("check_name = 'Channel_completeness'").first().status == "FAIL"


def test_text_quantities_get_their_type(spark, table, clean_rows, root):
    df = table([{**r, "Quantity": str(r["Quantity"])} for r in clean_rows],
               COLUMNS.replace("Quantity bigint", "Quantity string"))
    assert jobs.run_etl(spark, df, root).status == "SUCCESS"
    found = HistoryStore(spark, root).results().filter("check_name = 'dtype_compatibility'").first()
    assert found.status == "PASS"


def test_reports(spark, csv, tmp_path):
    source = csv({"UnitPrice": "0.0"})

    def read(path):
        return json.loads(spark.read.text(path).first().value)

    quality = read(jobs.validate_job(spark, source, str(tmp_path / "q.json"), "Retail"))
    assert quality["summary"] == {"total_checks": 16, "passed": 15, "warnings": 1, "failed": 0, "info": 0}
    assert quality["duration_seconds"] > 0 and [r["check_name"] for r in quality["results"]][:2] == ["column_presence", "unexpected_columns"]
    price = next(r for r in quality["results"] if r["check_name"] == "unit_price_validity")
    assert price["affected_pct"] == price["affected_percentage"] == 50.0
    scored = read(jobs.score_job(spark, source, str(tmp_path / "s.json"), "Retail"))
    assert (scored["score"], scored["status"], scored["dataset_name"]) == (96.67, "Healthy", "Retail")
    assert scored["category_scores"]["validity"]["details"] == "2.5/3 rule points earned."
    profiled = read(jobs.profile_job(spark, source, str(tmp_path / "p.json"), "Retail"))
    assert profiled["columns"][0]["sample_values"] == ["536365", "C536366"]
    assert [c["name"] for c in profiled["columns"]] == NAMES
    assert [c["name"] for c in profiled["numeric"]] == ["Quantity", "UnitPrice", "CustomerID"]
    assert profiled["numeric"][2]["std"] == 0.0 and "error" in profiled["date_analysis"][0]
    one = read(jobs.profile_job(spark, csv(rows=ROWS[:1]), str(tmp_path / "one.json"), "Retail"))
    assert one["numeric"][0]["std"] is None


def test_store_job(spark, csv, root, table, sale):
    store = HistoryStore(spark, root)
    run = jobs.store_job(spark, csv(), store).first()
    assert (run.run_id, run.status, run.health_score) == (1, "COMPLETED", 100.0)
    batches = table([sale, sale, {**sale, "Quantity": 0}]).withColumn(
        "run_id", (F.lit(10) + (F.col("Quantity") == 0).cast("int")).cast("bigint"))
    saved = {r.run_id: r for r in jobs.store_job(spark, batches, store, by=["run_id"]).collect()}
    assert set(saved) == {10, 11} and saved[10].rows_processed == 2
    assert store.results().count() == 48


def test_command_line(spark, csv, root, capsys):
    assert main(["etl", "--source", csv(), "--output", root]) == 0
    assert main(["etl", "--source", "/no/such/file.csv", "--output", root]) == 1
    assert main(["store", "--source", csv(), "--output", root]) == 0
    assert main(["quality", "--source", "/no/such/file.csv"]) == 1
    assert main(["score", "--source", csv(), "--output", root + "/score.json"]) == 0
    assert HistoryStore(spark, root).runs().count() == 2


def test_marts(table, sale):
    rows = [sale, {**sale, "InvoiceNo": "C1", "Quantity": -6}, {**sale, "StockCode": "X", "Description": None,
                                                                "InvoiceDate": "1/2/2011 9:00", "Country": None}]
    snapshot = to_snapshot(transform(table(rows)))
    assert tuple(marts.kpi_summary(snapshot).first()) == (3, 2, 2, 1, 15.3, 1)
    assert [tuple(r) for r in marts.monthly_revenue(snapshot).collect()] == [("2010-12-01", 0.0), ("2011-01-01", 15.3)]
    assert [r.stock_code for r in marts.top_products(snapshot).collect()] == ["X", "85123A"]
    assert [r.label for r in marts.labelled_products(snapshot).collect()] == ["85123A — HEART", "X — Unknown"]
    assert [r.country for r in marts.country_revenue(snapshot).collect()] == ["United Kingdom"]
    assert marts.cancellation_rate(snapshot).first().cancellation_rate == pytest.approx(100 / 3)
    assert marts.cancellation_rate(snapshot.filter("false")).first().cancellation_rate == 0.0


def test_database_sink_needs_a_driver(table, clean_rows):
    with pytest.raises(Exception):
        replace_database_table(table(clean_rows), "jdbc:nosuchdb://x", "t")
