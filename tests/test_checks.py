"""Outcome of every check on small tables with one planted fault each."""

import pytest
from pyspark.sql import functions as F

from assaykit import Check, Settings, results, summary, validate
from assaykit.operators.checks import (
    COMPLETENESS, UNIQUENESS, VALIDITY, Counts, Finding, Outcome, Table, default_checks, schema_check)
from assaykit.operators.measure import DIGEST
from assaykit.operators.validation import RESULTS, run_isolated
from conftest import COLUMNS


def outcomes(df, checks=None, **options):
    return {r.check_name: r for r in results(validate(df, checks, **options)).collect()}


def check_one(df, name, checks=None, **options):
    return outcomes(df, checks, **options)[name]


def test_clean_rows_pass_every_check(table, clean_rows):
    found = outcomes(table(clean_rows))
    assert len(found) == 16
    assert {r.status for r in found.values()} == {"PASS"}
    assert all(r.affected_rows == 0 and r.affected_percentage == 0.0 for r in found.values())
    assert [r.check_order for r in found.values()] == list(range(16))


def test_missing_column_is_critical(table, clean_rows):
    r = check_one(table(clean_rows).drop("CustomerID"), "column_presence")
    assert (r.status, r.severity, r.affected_rows, r.affected_percentage) == ("FAIL", "CRITICAL", 2, 100.0)
    assert r.message == "1 expected column(s) are missing: ['CustomerID']. Downstream checks will be unreliable."
    assert r.metadata["missing_columns"] == "['CustomerID']"


@pytest.mark.parametrize("extra, status, severity", [(1, "INFO", "LOW"), (3, "INFO", "LOW"), (4, "WARNING", "MEDIUM")])
def test_unexpected_columns(table, clean_rows, extra, status, severity):
    df = table(clean_rows).select("*", *[F.lit(1).alias(f"X{i}") for i in range(extra, 0, -1)])
    r = check_one(df, "unexpected_columns", [schema_check()])
    assert (r.status, r.severity, r.affected_rows) == (status, severity, 0)
    assert r.message.startswith(f"{extra} unexpected column(s) found: {[f'X{i}' for i in range(1, extra + 1)]}")


@pytest.mark.parametrize("column, dtype, status", [
    ("Quantity", "double", "WARNING"), ("Quantity", "int", "PASS"), ("UnitPrice", "float", "PASS"),
    ("CustomerID", "bigint", "WARNING"), ("InvoiceNo", "bigint", "WARNING")])
def test_type_families(table, clean_rows, column, dtype, status):
    df = table(clean_rows).withColumn(column, F.col(column).cast(dtype))
    assert check_one(df, "dtype_compatibility", [schema_check()]).status == status


def test_contract_override_and_empty_override(table, clean_rows):
    df = table(clean_rows).select("InvoiceNo")
    assert check_one(df, "column_presence", [schema_check(["InvoiceNo"], {"InvoiceNo": "string"})]).status == "PASS"
    assert check_one(df, "column_presence", [schema_check([], {})]).status == "FAIL"


@pytest.mark.parametrize("column, status, severity, remark", [
    ("CustomerID", "INFO", "INFO", " This is expected for guest transactions."),
    ("Description", "WARNING", "LOW", ""),
    ("Quantity", "FAIL", "HIGH", "")])
def test_completeness_policy(table, clean_rows, column, status, severity, remark):
    clean_rows[0] = {**clean_rows[0], column: None}
    r = check_one(table(clean_rows), f"{column}_completeness", [COMPLETENESS])
    assert (r.status, r.severity, r.affected_rows, r.affected_percentage) == (status, severity, 1, 50.0)
    assert r.message == f"{column} is missing 1 values (50.0%).{remark}"


def test_nan_is_missing(table, clean_rows):
    clean_rows[0] = {**clean_rows[0], "CustomerID": float("nan")}
    assert check_one(table(clean_rows), "CustomerID_completeness").affected_rows == 1


def test_odd_column_names(table, clean_rows):
    df = table(clean_rows).withColumnRenamed("Country", "Coun.try `%'s")
    found = outcomes(df)
    assert found["Coun.try `%'s_completeness"].message == "Coun.try `%'s is 100% complete."
    broken = df.withColumn("Coun.try `%'s", F.lit(None).cast("string"))
    assert outcomes(broken)["Coun.try `%'s_completeness"].message == "Coun.try `%'s is missing 2 values (100.0%)."


FAULTS = [
    ({"UnitPrice": -5.0}, "unit_price_validity", "FAIL", "HIGH", 1),
    ({"UnitPrice": 0.0}, "unit_price_validity", "WARNING", "LOW", 1),
    ({"Quantity": 0}, "quantity_zero", "FAIL", "MEDIUM", 1),
    ({"Quantity": -6, "InvoiceNo": "C1"}, "quantity_cancellation_logic", "PASS", "INFO", 0),
    ({"Quantity": -6}, "quantity_cancellation_logic", "FAIL", "HIGH", 1),
    ({"InvoiceNo": "C1"}, "quantity_cancellation_logic", "FAIL", "HIGH", 1),
    ({"InvoiceNo": "C1", "Quantity": None}, "quantity_cancellation_logic", "FAIL", "HIGH", 1),
    ({"InvoiceNo": "c1"}, "quantity_cancellation_logic", "PASS", "INFO", 0),
    ({"InvoiceNo": None, "Quantity": -6}, "quantity_cancellation_logic", "FAIL", "HIGH", 1),
    ({"Quantity": -6, "UnitPrice": 0.0, "CustomerID": None}, "quantity_cancellation_logic", "WARNING", "MEDIUM", 1),
    ({"Quantity": -6, "UnitPrice": 0.0}, "quantity_cancellation_logic", "FAIL", "HIGH", 1),
    ({"InvoiceDate": "Not a date"}, "invoice_date_validity", "FAIL", "HIGH", 1),
    ({"InvoiceDate": None}, "invoice_date_validity", "PASS", "INFO", 0),
    ({"InvoiceDate": "2010-12-01T08:26:00"}, "invoice_date_validity", "PASS", "INFO", 0),
    ({"InvoiceDate": "31/12/2010 8:26"}, "invoice_date_validity", "PASS", "INFO", 0),
]


@pytest.mark.parametrize("change, name, status, severity, rows", FAULTS)
@pytest.mark.parametrize("row_key", ["row", DIGEST])
def test_validity(table, clean_rows, change, name, status, severity, rows, row_key):
    clean_rows[0] = {**clean_rows[0], **change}
    r = check_one(table(clean_rows), name, [VALIDITY, UNIQUENESS], row_key=row_key)
    assert (r.status, r.severity, r.affected_rows) == (status, severity, rows)
    assert r.affected_percentage == 50.0 * rows


def test_negative_price_hides_zero_price(table, sale):
    rows = [sale, {**sale, "UnitPrice": 0.0}, {**sale, "UnitPrice": -1.0}]
    r = check_one(table(rows), "unit_price_validity")
    assert r.message == "UnitPrice is negative in 1 rows. Prices must be >= 0."


def test_adjustment_is_described(table, clean_rows):
    clean_rows[0].update(Quantity=-6, UnitPrice=0.0, CustomerID=None)
    r = check_one(table(clean_rows), "quantity_cancellation_logic")
    assert r.metadata == {"administrative_adjustment_rows": "1"}


def test_text_numbers_are_read_leniently(table, clean_rows):
    schema = COLUMNS.replace("Quantity bigint", "Quantity string").replace("UnitPrice double", "UnitPrice string")
    rows = [{**clean_rows[0], "Quantity": "0", "UnitPrice": "free"}, {**clean_rows[1], "Quantity": "1d", "UnitPrice": "-1"}]
    found = outcomes(table(rows, schema))
    assert found["quantity_zero"].affected_rows == 1
    assert found["unit_price_validity"].affected_rows == 1


def test_absent_columns_leave_rules_out(table, clean_rows):
    found = outcomes(table(clean_rows).drop("InvoiceNo", "UnitPrice"), [VALIDITY])
    assert list(found) == ["invoice_date_validity"]
    clean_rows[0].update(Quantity=-6, UnitPrice=0.0, CustomerID=None)
    r = check_one(table(clean_rows).drop("CustomerID"), "quantity_cancellation_logic")
    assert r.status == "FAIL"  # without CustomerID no row counts as an adjustment


@pytest.mark.parametrize("row_key", ["row", DIGEST])
def test_duplicates_count_extra_copies(table, clean_rows, row_key):
    r = check_one(table([*clean_rows, clean_rows[0]]), "duplicate_rows", row_key=row_key)
    assert (r.status, r.severity, r.affected_rows, r.affected_percentage) == ("WARNING", "MEDIUM", 1, 33.33)
    assert r.message == "Found 1 exact duplicate rows (33.33%)."


@pytest.mark.parametrize("row_key", ["row", DIGEST])
def test_nulls_in_different_places_are_different_rows(spark, row_key):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert check_one(df, "duplicate_rows", row_key=row_key).affected_rows == 1


def test_empty_table_has_schema_findings_only(table):
    report = validate(table([])).first()
    assert report.total_rows == 0
    assert [r.check_name for r in report.results] == ["column_presence", "unexpected_columns", "dtype_compatibility"]
    missing = check_one(table([]).drop("Country"), "column_presence")
    assert (missing.affected_rows, missing.affected_percentage) == (0, 100.0)


def test_summary_counts(table, clean_rows):
    clean_rows[0].update(UnitPrice=-1.0, CustomerID=None)
    s = summary(validate(table([*clean_rows, clean_rows[1]]))).first()
    assert (s.total_rows, s.total_checks, s.passed, s.warnings, s.failed, s.info) == (3, 16, 13, 1, 1, 1)


def test_batches_are_validated_apart(table, sale):
    rows = [sale, sale, {**sale, "Country": "France"}]
    df = table(rows).withColumn("batch", F.col("Country"))
    found = {(r.batch, r.check_name): r for r in results(validate(df, by=["batch"]), ["batch"]).collect()}
    assert found["United Kingdom", "duplicate_rows"].affected_rows == 1
    assert found["France", "duplicate_rows"].status == "PASS"
    assert ("France", "batch_completeness") not in found


def test_own_check_joins_the_pass(table, clean_rows):
    def findings(t: Table, n: Counts):
        return [Finding("foreign", "validity", (
            Outcome("WARNING", "LOW", "%s foreign rows", (n["foreign"],), when=f"{n['foreign']} > 0", rows=n["foreign"]),
            Outcome("PASS", "INFO", "none")))]

    check = Check("ForeignCheck", "validity", lambda t: {"foreign": F.col("Country") != "United Kingdom"}, findings)
    clean_rows[0]["Country"] = "France"
    r = check_one(table(clean_rows), "foreign", [*default_checks(), check])
    assert (r.status, r.message, r.affected_percentage) == ("WARNING", "1 foreign rows", 50.0)


def test_check_that_cannot_be_planned_is_reported(table, clean_rows):
    def broken(t):
        return {"x": F.col("NoSuchColumn") > 0}

    found = outcomes(table(clean_rows), [Check("BrokenCheck", "validity", broken), UNIQUENESS])
    assert (found["BrokenCheck"].status, found["BrokenCheck"].severity) == ("FAIL", "CRITICAL")
    assert found["BrokenCheck"].metadata == {"exception_type": "AnalysisException"}
    assert found["duplicate_rows"].status == "PASS"


def test_check_that_fails_while_running_is_reported(table, clean_rows):
    failing = Check("StrictCheck", "validity", lambda t: {"x": F.col("StockCode").cast("int") > 0},
                    lambda t, n: [Finding("strict", "validity", (Outcome("PASS", "INFO", "%s", (n["x"],)),))])
    found = run_isolated(table(clean_rows), lambda report: results(report).collect(), [*default_checks(), failing])
    by_name = {r.check_name: r for r in found}
    assert len(found) == 17 and by_name["StrictCheck"].status == "FAIL"
    assert (by_name["StrictCheck"].affected_rows, by_name["StrictCheck"].affected_percentage) == (2, 100.0)
    assert by_name["column_presence"].status == "PASS"


def test_limit_comes_from_settings(table, clean_rows):
    df = table(clean_rows).withColumn("X", F.lit(1))
    r = check_one(df, "unexpected_columns", settings=Settings(unexpected_column_limit=0))
    assert r.status == "WARNING"


def test_result_does_not_depend_on_partitions(table, sale):
    rows = [{**sale, "InvoiceNo": str(i % 40), "Quantity": i % 7 - 3} for i in range(300)] + [sale] * 200
    df = table(rows)
    expected = validate(df).first()[RESULTS]
    for other in (df.repartition(1), df.repartition(13, "Quantity"), df.orderBy(F.desc("InvoiceNo"))):
        for row_key in ("row", DIGEST):
            assert validate(other, row_key=row_key).first()[RESULTS] == expected


def _frame_rows(df, by, **more):
    fields = {"check_name": "own", "category": "validity", "status": "PASS", "severity": "INFO", "message": "m", **more}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("affected_rows")).select(
        *by, *[F.lit(v).alias(k) for k, v in fields.items()], "affected_rows", F.lit(0.0).alias("affected_percentage"))


def _raises(*_):
    raise ValueError("no rule file")


def _outcome(**parts):
    return lambda table, n: [Finding("own", "validity", (Outcome("WARNING", "LOW", "x %s", **{"args": ("1",), **parts}),))]


BROKEN = {
    "frame cannot be built": Check("Bad", "validity", frame=_raises),
    "frame lacks a field": Check("Bad", "validity", frame=lambda df, by: _frame_rows(df, by).drop("severity")),
    "frame fails while running": Check("Bad", "validity", frame=lambda df, by: _frame_rows(df, by).withColumn(
        "message", F.raise_error(F.lit("gone")).cast("string"))),
    "predicate names no column": Check("Bad", "validity", lambda t: {"x": F.col("nowhere") > 1}),
    "predicate fails while running": Check("Bad", "validity", lambda t: {"x": F.col("InvoiceNo").cast("int") > 1},
                                            lambda t, n: _outcome(args=(n["x"],))(t, n)),
    "outcome names no count": Check("Bad", "validity", findings=_outcome(rows="nowhere")),
    "outcome is no SQL": Check("Bad", "validity", findings=_outcome(args=("(((",))),
    "outcome fails while running": Check("Bad", "validity", findings=_outcome(args=("1 div (total_rows - total_rows)",))),
    "findings cannot be built": Check("Bad", "validity", findings=_raises),
}


@pytest.mark.parametrize("kind", BROKEN)
@pytest.mark.parametrize("by", [[], ["run_id"]])
def test_a_broken_check_is_one_finding_at_its_place(table, clean_rows, kind, by):
    df = table(clean_rows).withColumn("InvoiceNo", F.concat(F.lit("C"), "InvoiceNo")).withColumn("run_id", F.lit(1))
    df = df if by else df.drop("run_id")
    own = Check("Own", "validity", frame=_frame_rows)
    checks = [default_checks()[0], own, BROKEN[kind], default_checks()[-1], BROKEN[kind], own]
    found = run_isolated(df, lambda report: results(report, by).orderBy("check_order").collect(), checks, by)
    assert [r.check_name for r in found] == [
        "column_presence", "unexpected_columns", "dtype_compatibility", "own", "Bad", "duplicate_rows", "Bad", "own"]
    for bad in (found[4], found[6]):
        assert (bad.status, bad.severity, bad.affected_rows, bad.affected_percentage) == ("FAIL", "CRITICAL", 2, 100.0)
        assert bad.metadata["exception_type"] and bad.message.startswith("The check could not run: ")
    assert {r.status for i, r in enumerate(found) if i not in (4, 6)} == {"PASS"}


def test_frame_findings_keep_order_and_metadata(table, clean_rows):
    def frame(df, by):
        rows = [("zeta", 1, {"k": "v"}), ("alpha", 2, None), ("beta", 0, {"a": "1", "b": "2"})]
        one = df.groupBy().agg(F.count(F.lit(1)).alias("affected_rows"))
        return one.select("affected_rows", F.inline(F.array(*[F.struct(
            F.lit(n).alias("check_name"), F.lit(i).alias("finding_order"),
            F.create_map(*[F.lit(x) for kv in (m or {}).items() for x in kv]).cast("map<string,string>").alias("metadata")) for n, i, m in rows]))
        ).select("*", *[F.lit(x).alias(c) for c, x in (("category", "validity"), ("status", "PASS"), ("severity", "INFO"), ("message", "m"))],
                 F.lit(0.0).alias("affected_percentage"))
    found = results(validate(table(clean_rows), [Check("Own", "validity", frame=frame), default_checks()[-1]])).orderBy("check_order").collect()
    assert [(r.check_name, r.metadata) for r in found] == [
        ("beta", {"a": "1", "b": "2"}), ("zeta", {"k": "v"}), ("alpha", {}), ("duplicate_rows", {})]
