import pytest
from pyspark.sql import functions as F

from assaykit import category_scores, score, validate
from assaykit.operators.checks import FINDING_TYPE
from assaykit.operators.scoring import dashboard_label, label, run_state
from assaykit.operators.validation import RESULTS, report_from_results, results
from assaykit.config import Settings


@pytest.fixture
def report(spark):
    def make(*found):
        rows = [(n, c, s, v, "", 0, 0.0, {}) for n, c, s, v in found]
        return spark.createDataFrame([(3, 0, rows)], f"total_rows bigint, repeated_rows bigint, {RESULTS} array<{FINDING_TYPE}>")
    return make


def test_empty_report_scores_nothing(report):
    row = score(report()).first()
    assert (row.health_score, row.health_label, row.failure_reason) == (0.0, "Critical", None)
    assert {d.details for d in row.category_scores} == {"No validation results available for this dimension."}


def test_critical_schema_failure_is_a_gate(report):
    row = score(report(("column_presence", "schema", "FAIL", "CRITICAL"), ("a", "validity", "PASS", "INFO"))).first()
    assert (row.health_score, row.health_label, row.failure_reason) == (0.0, "Critical", "CRITICAL SCHEMA FAILURE")
    assert all(d.score == 0.0 and d.included_checks == [] for d in row.category_scores)


def test_other_failures_are_no_gate(report):
    row = score(report(("dtype", "schema", "FAIL", "HIGH"), ("x", "validity", "FAIL", "CRITICAL"),
                       ("y", "uniqueness", "PASS", "INFO"))).first()
    assert row.health_score == 20.0 and row.failure_reason is None


def test_points(report):
    found = [(s, "completeness", s, "LOW") for s in ("PASS", "INFO", "WARNING", "FAIL")]
    rows = {r.dimension: r for r in category_scores(score(report(*found))).collect()}
    assert rows["completeness"].score == 12.5
    assert rows["completeness"].details == "2.5/4 rule points earned."
    assert [c.points for c in rows["completeness"].included_checks] == [1.0, 1.0, 0.5, 0.0]


def test_cancellation_rule_is_its_own_dimension(report):
    rows = {r.dimension: r for r in category_scores(score(report(
        ("quantity_cancellation_logic", "validity", "WARNING", "MEDIUM"), ("p", "validity", "FAIL", "HIGH")))).collect()}
    assert (rows["business_rules"].score, rows["validity"].score) == (10.0, 0.0)


def test_unknown_dimension_is_ignored(report):
    assert score(report(("x", "freshness", "PASS", "INFO"), ("y", None, "PASS", "INFO"))).first().health_score == 0.0


def test_labels(spark):
    df = spark.createDataFrame([(100.0,), (90.0,), (89.99,), (75.0,), (50.0,), (49.99,)], "s double")
    shown = [tuple(r) for r in df.select(label(F.col("s"), Settings().labels), dashboard_label(F.col("s"))).collect()]
    assert shown == [("Healthy", "Excellent"), ("Healthy", "Excellent"), ("Warning", "Good"), ("Warning", "Good"),
                     ("Poor", "Poor"), ("Critical", "Critical")]


def test_run_state(spark):
    df = spark.createDataFrame([("SUCCESS",), ("COMPLETED",), ("WARNING",), ("FAILED",)], "s string")
    assert [r[0] for r in df.select(run_state(F.col("s"))).collect()] == ["healthy", "healthy", "warning", "failed"]


def test_published_example(report):
    """The known findings of the public retail table give its published score of 72.08."""
    columns = ("InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "Country")
    found = [(n, "schema", "PASS", "INFO") for n in ("column_presence", "unexpected_columns", "dtype_compatibility")]
    found += [(f"{c}_completeness", "completeness", "PASS", "INFO") for c in columns]
    found += [("Description_completeness", "completeness", "WARNING", "LOW"),
              ("CustomerID_completeness", "completeness", "INFO", "INFO"),
              ("unit_price_validity", "validity", "FAIL", "HIGH"), ("quantity_zero", "validity", "PASS", "INFO"),
              ("quantity_cancellation_logic", "validity", "WARNING", "MEDIUM"),
              ("invoice_date_validity", "validity", "PASS", "INFO"), ("duplicate_rows", "uniqueness", "WARNING", "MEDIUM")]
    row = score(report(*found)).first()
    assert (row.health_score, row.health_label) == (72.08, "Poor")
    assert round(sum(d.score for d in row.category_scores), 2) == row.health_score


def test_stored_findings_give_the_same_score(table, clean_rows):
    df = table([*clean_rows, clean_rows[0]]).withColumn("run_id", F.lit(7).cast("bigint"))
    report = validate(df, by=["run_id"])
    again = report_from_results(results(report, ["run_id"]), report.select("run_id"), ["run_id"])
    assert score(again).first().health_score == score(report).first().health_score == 90.0


def test_weights_come_from_settings(report):
    row = score(report(("x", "validity", "PASS", "INFO")), Settings(weights={"validity": 60.0, "schema": 40.0})).first()
    assert row.health_score == 60.0
