import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from assaykit.operators import profiling as P
from assaykit.operators.profiling import profile, profile_document
from assaykit.plans import jobs


@pytest.fixture
def sample(table):
    uk = "United Kingdom"
    rows = [
        ("536365", "85123A", "HEART", 6, "12/1/2010 8:26", 2.55, 17850.0, uk),
        ("536366", "71053", "LANTERN", 6, "12/1/2010 8:28", 3.39, 17850.0, uk),
        ("536367", "84406B", "HANGER", 8, "12/2/2010 8:34", 2.75, 13047.0, uk),
        ("C536368", "22632", "WARMER", -8, "12/2/2010 8:34", 1.85, None, "France"),
        ("536365", "85123A", "HEART", 6, "12/1/2010 8:26", 2.55, 17850.0, uk),
    ]
    return table(rows)


def test_overview(sample):
    row = P.overview(sample).first()
    assert (row.rows, row["columns"]) == (5, 8)
    assert row.column_names.startswith("InvoiceNo, StockCode") and row.data_bytes > 5 * 24


def test_columns(sample):
    rows = {r.name: r for r in P.columns_profile(sample).collect()}
    assert len(rows) == 8
    customer = rows["CustomerID"]
    assert (customer.dtype, customer.null_count, customer.null_percentage, customer.unique_count) == ("double", 1, 20.0, 2)
    assert customer.sample_values == ["13047.0", "17850.0"]
    assert rows["Quantity"].sample_values == ["-8", "6", "8"]


def test_first_seen_samples(spark, sample):
    df = sample.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    rows = {r.name: r for r in P.columns_profile(df, order_by="at").collect()}
    assert rows["Quantity"].sample_values == ["6", "8", "-8"]
    assert "at" not in rows


def test_numeric(sample):
    rows = {r.name: r for r in P.numeric_profile(sample).collect()}
    q = [6, 6, 8, -8, 6]
    assert rows["Quantity"]["min"] == -8 and rows["Quantity"]["max"] == 8
    assert rows["Quantity"]["mean"] == pytest.approx(statistics.mean(q), abs=1e-4)
    assert rows["Quantity"]["std"] == pytest.approx(statistics.stdev(q), abs=1e-4)
    assert rows["Quantity"]["median"] == 6 and rows["CustomerID"]["median"] == 17850.0
    assert set(rows) == {"Quantity", "UnitPrice", "CustomerID"}


def test_single_row_has_no_deviation(sample):
    row = P.numeric_profile(sample.limit(1).select("UnitPrice")).first()
    assert row["std"] is None and row["median"] == row["mean"]


@pytest.mark.parametrize("seed", range(4))
def test_median_matches_sorting(spark, seed):
    rnd = random.Random(seed)
    makers = [lambda: rnd.gauss(0, 1e6), lambda: float(rnd.randint(-3, 3)), lambda: rnd.choice([1e300, -1e300, 1e-300, 0.0]),
              lambda: 7.25 if rnd.random() < 0.4 else rnd.expovariate(1e-9)]
    values = [[m() for _ in range(rnd.randint(1, 700))] for m in makers]
    width = max(map(len, values))
    rows = [tuple(v[i] if i < len(v) else None for v in values) for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(makers))))
    found = {r["column"]: r["median"] for r in P.medians(df).collect()}
    assert found == {f"c{i}": statistics.median(v) for i, v in enumerate(values)}


def test_median_with_infinities_and_booleans(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf, True), (1.0, False), (2.0, True), (-inf, True), (inf, None)], "a double, b boolean")
    found = {r["column"]: r["median"] for r in P.medians(df).collect()}
    assert found == {"a": 2.0, "b": 1.0}
    all_inf = spark.createDataFrame([(inf,), (inf,), (-inf,)], "a double")
    assert P.medians(all_inf).first()["median"] == inf


def test_missing(sample):
    total = P.missing_summary(sample).first()
    assert tuple(total) == (1, 2.5, 1)
    assert [tuple(r) for r in P.missing_per_column(sample).collect()] == [("CustomerID", 1, 20.0)]


def test_duplicates(sample):
    assert tuple(P.duplicates_profile(sample).first()) == (1, 20.0, 4)
    assert tuple(P.duplicates_profile(sample.dropDuplicates()).first()) == (0, 0.0, 4)


def test_dates(sample):
    row = P.dates_profile(sample).first()
    assert (row.earliest_date, row.latest_date) == ("2010-12-01T08:26:00", "2010-12-02T08:34:00")
    assert (row.date_span_days, row.invalid_dates, row.total_trading_days) == (1, 0, 2)
    assert (row.min_transactions_per_day, row.max_transactions_per_day, row.mean_transactions_per_day) == (2, 3, 2.5)


def test_span_counts_whole_days(spark):
    df = spark.createDataFrame([("2010-12-01 08:26:00",), ("2011-12-09 08:00:00",)], "InvoiceDate string")
    assert P.dates_profile(df).first().date_span_days == 372


def test_dates_follow_one_layout(spark):
    rows = [("12/1/2010 8:26",), ("12/2/2010 8:26",), ("2010-12-03T08:26:00",), ("13/12/2010 8:26",), (None,), ("junk",)]
    df = spark.createDataFrame(rows, "InvoiceDate string").coalesce(1)
    row = P.dates_profile(df).first()
    assert (row.invalid_dates, row.latest_date) == (4, "2010-12-02T08:26:00")
    reordered = df.orderBy(F.desc(F.col("InvoiceDate") == "2010-12-03T08:26:00")).coalesce(1).withColumn(
        "at", F.monotonically_increasing_id())
    row = P.dates_profile(reordered, order_by="at").first()
    assert (row.invalid_dates, row.latest_date) == (5, "2010-12-03T08:26:00")


def test_dates_without_any_date(spark, sample):
    none = P.dates_profile(spark.createDataFrame([("x",)], "InvoiceDate string")).first()
    assert none.error == "No valid dates could be parsed" and none.invalid_dates == 1
    assert P.dates_profile(sample.drop("InvoiceDate")).first().error == "InvoiceDate column not found"


def test_business(sample):
    row = P.business_profile(sample).first().asDict()
    assert row == {
        "unique_customers": 2, "rows_without_customer_id": 1, "unique_products": 4, "unique_countries": 2,
        "unique_invoices": 4, "cancellation_invoices": 1, "cancellation_percentage": 20.0,
        "negative_quantity_rows": 1, "zero_quantity_rows": 0, "negative_on_non_cancellation": 0,
        "min_quantity": -8, "max_quantity": 8, "zero_price_rows": 0, "negative_price_rows": 0,
        "min_price": 1.85, "max_price": 3.39, "mean_price": 2.62}


def test_business_with_some_columns(sample):
    row = P.business_profile(sample.select("Quantity")).first().asDict()
    assert row["negative_on_non_cancellation"] == 0 and "unique_invoices" not in row


def test_top_countries(sample):
    assert [tuple(r) for r in P.top_countries(sample).collect()] == [("United Kingdom", 4), ("France", 1)]


def test_flags(sample, table, clean_rows):
    found = {r.flag: r for r in P.flags(sample.withColumn("X", F.lit(1)).drop("Country")).collect()}
    assert set(found) == {"DUPLICATE_ROWS_DETECTED", "MISSING_EXPECTED_COLUMNS", "UNEXPECTED_EXTRA_COLUMNS"}
    assert found["DUPLICATE_ROWS_DETECTED"].message == "1 fully duplicate rows found."
    clean = P.flags(table(clean_rows)).collect()
    assert [(r.flag, r.severity) for r in clean] == [("NO_CRITICAL_FLAGS", "OK")]
    half = table([{**clean_rows[0], "CustomerID": None}, clean_rows[1]])
    assert P.flags(half).first().message == "50.0% of rows have no CustomerID."


def test_distinct_values_keep_types_apart(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big, 0.0, True), (big + 1, -0.0, False), (None, float("nan"), None)],
                               "a bigint, b double, c boolean")
    rows = {r.name: r for r in P.columns_profile(df).collect()}
    assert [rows[n].unique_count for n in "abc"] == [2, 1, 2]
    assert [rows[n].null_count for n in "abc"] == [1, 1, 1]
    assert rows["c"].sample_values == ["False", "True"]


def test_empty_table(table):
    df = table([])
    assert {r.null_percentage for r in P.columns_profile(df).collect()} == {None}
    assert P.missing_summary(df).first().total_missing_percentage is None
    assert P.flags(df).first().flag == "NO_CRITICAL_FLAGS"


def test_document(sample):
    text = profile_document(profile(sample), "Sample").first().value
    report = json.loads(text)
    assert report["dataset"]["name"] == "Sample"
    assert report["overview"][0]["rows"] == 5 and len(report["columns"]) == 8
    assert report["duplicates"] == [{"duplicate_row_count": 1, "duplicate_percentage": 20.0, "unique_rows": 4}]


@pytest.mark.parametrize("order_by", [None, "at"])
def test_dates_are_the_same_from_rows_and_from_distinct_values(spark, order_by):
    texts = ["2010-12-01T08:26:00", "2010-12-01T08:26:00", "2010-12-02T09:00:00", "12/1/2010 8:26", "never", None, None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "InvoiceDate string, at int")
    df = df if order_by else df.drop("at")
    values = P.value_counts(df, ["InvoiceDate"], order_by)
    one, other = (P.daily_volume(df, order_by=order_by, values=v).collect() for v in (None, values))
    assert sorted(map(str, one)) == sorted(map(str, other)) and sum(r["rows"] for r in other) == 7
    assert P.dates_profile(df, order_by=order_by, values=values).first() == P.dates_profile(df, order_by=order_by).first()


def test_the_report_works_its_source_out_once(spark, table, clean_rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(text):
        seen.add(1)
        return text

    df = table(clean_rows).withColumn("Country", F.udf(note, "string").asNondeterministic()("Country"))
    jobs.profile_job(spark, df, str(tmp_path / "profile"))
    assert seen.value == len(clean_rows)
