"""Queries over the supplied tables, one per capability. Each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.dates import elapsed_seconds, iso_text, parse_date
from assaykit.functions.values import ref
from assaykit.operators import history, marts, measure, profiling
from assaykit.operators.checks import (
    Check, Counts, Finding, Outcome, Table, adjustment, default_checks)
from assaykit.operators.scoring import category_scores, dashboard_label, run_state, score
from assaykit.operators.transform import problems, to_snapshot, transform
from assaykit.operators.validation import (
    acceptable_by_category, as_records, report_from_results, results, summary, validate)
from assaykit.plans import jobs
from assaykit.session import stored, workspace
from assaykit.sources.readers import dataset_info, load_csv
from assaykit.sources.retail import retail
from assaykit.sources.store import HistoryStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FOUND = ("check_name", "category", "status", "severity", "message", "affected_rows", "affected_percentage")
RUN = ["run_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def clean(spark: SparkSession, folder: str, grouped: bool = False) -> DataFrame:
    return retail(spark, folder, grouped=grouped)


def faulty(spark: SparkSession, folder: str, grouped: bool = False) -> DataFrame:
    return retail(spark, folder, faulty=True, grouped=grouped)


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty table with the month of each row."""
    return retail(spark, folder, faulty=True, batch=True, grouped=True)


def snapshot_of(spark: SparkSession, folder: str) -> DataFrame:
    return to_snapshot(transform(clean(spark, folder)))


def _order(df: DataFrame) -> DataFrame:
    return df.withColumn("check_order", F.col("check_order").cast("bigint"))


def _findings(report: DataFrame) -> DataFrame:
    return _order(results(report).select("check_order", *FOUND))


# Validation and scores ---------------------------------------------------------------------------

def _score_row(df: DataFrame, row_key: str = measure.ROW) -> DataFrame:
    return score(validate(df, row_key=row_key)).select(
        "total_rows", F.col("repeated_rows").alias("duplicate_rows"), "health_score", "health_label",
        dashboard_label(F.col("health_score")).alias("dashboard_label"))


@query
def health_score(spark, folder):
    return _score_row(clean(spark, folder, grouped=True))


@query
def health_score_faulty(spark, folder):
    return _score_row(faulty(spark, folder, grouped=True))


@query
def health_score_digest(spark, folder):
    return _score_row(clean(spark, folder), measure.DIGEST)


def _dimension_rows(df: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("included_checks", lambda c: F.concat(
        c["check_name"], F.lit(":"), c["status"], F.lit(":"), c["points"].cast("string"))), ",")
    return category_scores(score(validate(df))).select(
        "dimension", "score", "max_score", "details", listed.alias("included_checks"))


@query
def category_scores_clean(spark, folder):
    return _dimension_rows(clean(spark, folder, grouped=True))


@query
def category_scores_faulty(spark, folder):
    return _dimension_rows(faulty(spark, folder, grouped=True))


@query
def quality_results(spark, folder):
    return _findings(validate(clean(spark, folder, grouped=True)))


@query
def quality_results_faulty(spark, folder):
    return _findings(validate(faulty(spark, folder, grouped=True)))


@query
def quality_results_transformed(spark, folder):
    return _findings(validate(transform(clean(spark, folder, grouped=True))))


@query
def quality_summary(spark, folder):
    return summary(validate(faulty(spark, folder, grouped=True)))


@query
def quality_records(spark, folder):
    rows = as_records(results(validate(faulty(spark, folder, grouped=True))))
    return rows.select("check_name", "affected_percentage", "affected_pct",
                       F.col("passed").cast("bigint").alias("passed"), F.col("failed").cast("bigint").alias("failed"))


@query
def acceptable_checks(spark, folder):
    return acceptable_by_category(results(validate(clean(spark, folder, grouped=True))))


def _drifted(df: DataFrame) -> DataFrame:
    """A required column is gone, four are new, one has another type."""
    return df.select(
        "InvoiceNo", "StockCode", "Description", F.col("Quantity").cast("double").alias("Quantity"),
        "InvoiceDate", "UnitPrice", "Country", *[F.lit(n).alias(n) for n in ("Batch", "Channel", "Region", "Store")])


@query
def schema_check(spark, folder):
    return _findings(validate(_drifted(clean(spark, folder)), default_checks()[:1]))


@query
def critical_gate(spark, folder):
    scored = score(validate(_drifted(clean(spark, folder, grouped=True))))
    return category_scores(scored, ["health_score", "health_label", "failure_reason"]).drop("included_checks")


@query
def completeness(spark, folder):
    df = clean(spark, folder)
    return profiling.null_counts(df).select(
        "name", "rows", "missing_count",
        F.round(F.col("missing_count") / F.col("rows") * 100, 2).alias("missing_percentage"))


@query
def validity_counts(spark, folder):
    df = faulty(spark, folder)
    check = next(c for c in default_checks() if c.name == "ValidityCheck")
    rules = check.predicates(Table(dict(df.dtypes), Settings()))
    return measure.measure(df, df.columns, rules, row_key=measure.NONE).drop(measure.REPEATS)


def _copies(df: DataFrame, row_key: str) -> DataFrame:
    return measure.measure(df, df.columns, {}, row_key=row_key).withColumnRenamed(measure.REPEATS, "duplicate_rows")


@query
def duplicates(spark, folder):
    return _copies(clean(spark, folder, grouped=True), measure.ROW)


@query
def duplicates_exact(spark, folder):
    """The table in files: digests first, whole rows only where a digest repeats."""
    return _copies(stored(clean(spark, folder), "retail"), measure.EXACT)


@query
def duplicates_digest(spark, folder):
    return _copies(clean(spark, folder), measure.DIGEST)


@query
def adjustments(spark, folder):
    df = clean(spark, folder)
    found = df.filter(adjustment(Table(dict(df.dtypes), Settings())))
    return found.groupBy(F.col("Country").alias("country")).agg(F.count(F.lit(1)).alias("adjustment_rows"))


def _bulk_check() -> Check:
    def findings(table: Table, n: Counts) -> list[Finding]:
        bulk = Outcome("WARNING", "LOW", "%s rows have 45 units or more.", (n["bulk"],), rows=n["bulk"])
        return [Finding("bulk_orders", "validity", (bulk,), given=f"{n['bulk']} > 0")]

    return Check("BulkCheck", "validity", lambda table: {"bulk": table.number("Quantity") >= 45}, findings)


def _country_frame(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of the largest country, as a check with a plan of its own."""
    per_country = df.groupBy(*[ref(b) for b in by], "Country").agg(F.count(F.lit(1)).alias("n"))
    return per_country.groupBy(*[ref(b) for b in by]).agg(
        F.max("n").alias("top"), F.sum("n").alias("all")).select(
        *[ref(b) for b in by], F.lit("country_concentration").alias("check_name"),
        F.lit("validity").alias("category"),
        F.when(F.col("top") * 2 > F.col("all"), "WARNING").otherwise("PASS").alias("status"),
        F.lit("LOW").alias("severity"),
        F.concat(F.lit("Largest country has "), F.col("top").cast("string"), F.lit(" rows.")).alias("message"),
        F.col("top").alias("affected_rows"), F.round(F.col("top") / F.col("all") * 100, 2).alias("affected_percentage"))


@query
def custom_checks(spark, folder):
    checks = [*default_checks(), _bulk_check(), Check("CountryCheck", "validity", frame=_country_frame)]
    return _findings(validate(clean(spark, folder, grouped=True), checks))


@query
def isolated_failure(spark, folder):
    """A check that cannot run is reported, and the others still are."""
    def unable(table: Table):
        raise ValueError("rule file is missing")

    checks = [*default_checks()[:2], Check("TariffCheck", "validity", unable), *default_checks()[2:]]
    return _findings(validate(clean(spark, folder, grouped=True), checks))


# Profile -----------------------------------------------------------------------------------------

@query
def profile_overview(spark, folder):
    return profiling.overview(clean(spark, folder)).select("rows", "columns", "column_names", "data_bytes", "data_mb")


@query
def dataset_structure(spark, folder):
    return profiling.structure(clean(spark, folder))


@query
def profile_columns(spark, folder):
    return profiling.columns_profile(clean(spark, folder)).select(
        "name", "dtype", "null_count", "null_percentage", "unique_count",
        F.array_join("sample_values", "|").alias("sample_values"))


@query
def profile_samples(spark, folder):
    return profiling.samples(faulty(spark, folder)).select(F.col("column").alias("name"), "rank", "value")


@query
def profile_numeric(spark, folder):
    return profiling.numeric_profile(clean(spark, folder))


@query
def profile_numeric_prices(spark, folder):
    """Medians over columns with many distinct values."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_extendedprice", "l_discount", "l_orderkey")
    return profiling.numeric_profile(lines)


@query
def profile_numeric_tails(spark, folder):
    """Medians of a long tail, of a column with outliers and infinities, and of one that is crowded near zero."""
    order, price = F.col("l_orderkey"), F.col("l_extendedprice")
    rest = order % 499
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        (price * price * price).alias("cubed"),
        F.when(rest == 1, float("inf")).when(rest == 2, float("-inf")).when(rest == 3, 1e300).when(rest == 4, -1e300)
        .otherwise(price).alias("outliers"), (1.0 / (1 + order)).alias("reciprocal"))
    return profiling.medians(lines).withColumnRenamed("column", "name")


@query
def profile_missing(spark, folder):
    return profiling.missing_summary(clean(spark, folder))


@query
def profile_missing_columns(spark, folder):
    return profiling.missing_per_column(clean(spark, folder))


@query
def profile_duplicates(spark, folder):
    return profiling.duplicates_profile(clean(spark, folder, grouped=True), measure.ROW)


@query
def profile_dates(spark, folder):
    return profiling.dates_profile(faulty(spark, folder)).drop("error")


# Layouts in which the query below writes one date column.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy H:mm", "MMM d yyyy", "d-MMM-yy", "MM/dd/yy hh:mm a", "EEE, dd MMM yyyy HH:mm:ss",
           "yyyy.MM.dd", "yyyyMMdd'T'HHmmss")


@query
def mixed_dates(spark, folder):
    """One text column in eight layouts: all of them are dates, and the right ones."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_shipdate", (F.col("l_orderkey") % 8).alias("layout"))
    text = F.coalesce(*[F.when(F.col("layout") == i, F.date_format("l_shipdate", f)) for i, f in enumerate(LAYOUTS)])
    parsed = lines.withColumn("text", text).withColumn("ts", parse_date(F.col("text")))
    return parsed.groupBy("layout").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("bad_dates"),
        F.count_if(F.col("ts") != F.col("l_shipdate")).alias("wrong_dates"),
        iso_text(F.min("ts")).alias("earliest"), iso_text(F.max("ts")).alias("latest"))


@query
def profile_daily_volume(spark, folder):
    days = profiling.daily_volume(clean(spark, folder))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rows").orderBy("day")


@query
def profile_business(spark, folder):
    return profiling.business_profile(faulty(spark, folder))


@query
def profile_top_countries(spark, folder):
    return profiling.top_countries(clean(spark, folder))


@query
def profile_flags(spark, folder):
    return profiling.flags(_drifted(clean(spark, folder, grouped=True)), row_key=measure.ROW)


@query
def profile_flags_clean(spark, folder):
    return profiling.flags(clean(spark, folder, grouped=True), row_key=measure.ROW)


# Transform and marts -----------------------------------------------------------------------------

@query
def transform_retail(spark, folder):
    df = clean(spark, folder)
    out = transform(df)
    return out.withColumn("IsCancellation", F.col("IsCancellation").cast("bigint"))


@query
def transform_problems(spark, folder):
    df = faulty(spark, folder)
    return df.agg(*[c.alias(n) for n, c in problems(df).items()])


def _shown_snapshot(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumns({
        "invoice_date": iso_text(F.col("invoice_date")),
        "is_cancellation": F.col("is_cancellation").cast("bigint"),
    })


@query
def snapshot_rows(spark, folder):
    return _shown_snapshot(snapshot_of(spark, folder))


@query
def kpi_summary(spark, folder):
    return marts.kpi_summary(snapshot_of(spark, folder))


@query
def monthly_revenue(spark, folder):
    return marts.monthly_revenue(snapshot_of(spark, folder))


@query
def top_products(spark, folder):
    return marts.top_products(snapshot_of(spark, folder))


@query
def product_labels(spark, folder):
    return marts.labelled_products(snapshot_of(spark, folder))


@query
def country_revenue(spark, folder):
    return marts.country_revenue(snapshot_of(spark, folder))


@query
def cancellation_rate(spark, folder):
    return marts.cancellation_rate(snapshot_of(spark, folder))


@query
def sql_query(spark, folder):
    return history.run_query(
        spark,
        "SELECT country, count(*) AS sales, CAST(sum(quantity) AS bigint) AS units FROM {snapshot}"
        " WHERE quantity >= :least AND NOT is_cancellation GROUP BY country",
        {"least": 10}, snapshot=snapshot_of(spark, folder))


# History: one run per shipping month of the faulty table -----------------------------------------

def monthly_reports(spark: SparkSession, folder: str) -> DataFrame:
    return score(validate(monthly(spark, folder), by=RUN))


def _clocked(reports: DataFrame) -> DataFrame:
    """Run times taken from the data: the month, and one millisecond per row."""
    months = F.make_interval(months=(F.col("run_id") - 1).cast("int"))
    started = F.to_timestamp(F.lit("1970-01-01 00:00:00")) + months
    finished = F.timestamp_micros(F.unix_micros(started) + F.col("total_rows") * 1000)
    return reports.withColumns({"started_at": started, "finished_at": finished})


def runs_of(reports: DataFrame) -> DataFrame:
    return _clocked(reports).select(
        "run_id", F.lit("online_retail_quality_pipeline").alias("pipeline_name"), "started_at", "finished_at",
        elapsed_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"),
        F.lit("COMPLETED").alias("status"), F.col("total_rows").alias("rows_processed"), "health_score")


def results_of_reports(reports: DataFrame) -> DataFrame:
    return _order(results(reports, RUN)).select(
        history.result_id(F.col("run_id"), F.col("check_order")).alias("result_id"), "run_id", "check_order", *FOUND)


def monthly_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_of(monthly_reports(spark, folder))


def monthly_results(spark: SparkSession, folder: str) -> DataFrame:
    return results_of_reports(validate(monthly(spark, folder), by=RUN))


def monthly_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs and findings for queries that need both.

    The reports, one row per run, are written once, so that the table is not validated a second time
    for the other side.
    """
    reports = stored(monthly_reports(spark, folder).select("run_id", "total_rows", "health_score", "results"), "reports")
    return runs_of(reports), results_of_reports(reports)


def _timed(runs: DataFrame) -> DataFrame:
    return runs.withColumns({c: iso_text(F.col(c)) for c in ("started_at", "finished_at") if c in runs.columns})


def _no_order(rows: DataFrame) -> DataFrame:
    return rows.drop("check_order")


@query
def batch_scores(spark, folder):
    return monthly_reports(spark, folder).select(
        "run_id", "total_rows", F.col("repeated_rows").alias("duplicate_rows"), "health_score", "health_label")


@query
def batch_category_scores(spark, folder):
    return category_scores(monthly_reports(spark, folder), RUN).drop("included_checks")


@query
def batch_summary(spark, folder):
    return summary(validate(monthly(spark, folder), by=RUN), RUN)


@query
def rescored_runs(spark, folder):
    """Scores worked out again from stored findings."""
    runs, found = monthly_tables(spark, folder)
    return score(report_from_results(found, runs.select("run_id"), RUN)).select("run_id", "health_score", "health_label")


@query
def all_runs(spark, folder):
    return _timed(history.all_runs(monthly_runs(spark, folder)))


@query
def run_history(spark, folder):
    return _timed(history.run_history(monthly_runs(spark, folder)))


@query
def latest_run(spark, folder):
    return _timed(history.latest_run(monthly_runs(spark, folder)))


@query
def latest_run_info(spark, folder):
    return history.latest_run_info(monthly_runs(spark, folder))


@query
def recent_runs(spark, folder):
    return _timed(history.recent_runs(monthly_runs(spark, folder), 10))


@query
def score_history(spark, folder):
    return _timed(history.score_history(monthly_runs(spark, folder), 30))


@query
def score_trend(spark, folder):
    return _timed(history.score_trend(monthly_runs(spark, folder)))


@query
def score_delta(spark, folder):
    return history.score_delta(monthly_tables(spark, folder)[0])


@query
def score_delta_by_name(spark, folder):
    return history.score_delta(monthly_tables(spark, folder)[0], per_name=True)


@query
def run_series(spark, folder):
    return history.run_series(monthly_runs(spark, folder))


@query
def result_log(spark, folder):
    return history.all_results(monthly_results(spark, folder))


@query
def results_of_run(spark, folder):
    return _no_order(history.results_of(monthly_results(spark, folder), 320))


@query
def failed_checks(spark, folder):
    return _no_order(history.failed_checks(monthly_results(spark, folder)))


@query
def warning_checks(spark, folder):
    return _no_order(history.warning_checks(monthly_results(spark, folder), 320))


@query
def check_details(spark, folder):
    runs, found = monthly_tables(spark, folder)
    return history.latest_details(found, runs)


@query
def attention(spark, folder):
    runs, found = monthly_tables(spark, folder)
    return history.attention(found, runs)


@query
def status_mix(spark, folder):
    runs, found = monthly_tables(spark, folder)
    return history.status_mix(found, runs)


@query
def category_status(spark, folder):
    runs, found = monthly_tables(spark, folder)
    return history.category_status(found, runs)


@query
def latest_cards(spark, folder):
    runs, found = monthly_tables(spark, folder)
    return history.latest_cards(found, runs)


@query
def results_per_run(spark, folder):
    return history.results_per_run(monthly_results(spark, folder))


@query
def runs_with_results(spark, folder):
    joined = history.runs_with_results(*monthly_tables(spark, folder))
    listed = F.array_join(F.transform("quality_results", lambda r: F.concat(
        r["check_name"], F.lit(":"), r["status"])), ",")
    return joined.select("run_id", "rows_processed", "health_score", listed.alias("quality_results"))


@query
def run_results(spark, folder):
    joined = history.run_results(*monthly_tables(spark, folder))
    return joined.select("result_id", "run_id", "pipeline_name", "run_status", "health_score", "check_name", "status")


def _kept_runs(runs: DataFrame) -> DataFrame:
    return history.without_runs(runs, runs.filter(F.col("run_id") % 7 == 0))


@query
def orphan_results(spark, folder):
    """Findings whose run has been removed from the run table."""
    runs, found = monthly_tables(spark, folder)
    return history.orphan_results(found, _kept_runs(runs)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("results"))


@query
def runs_after_removal(spark, folder):
    return _kept_runs(monthly_tables(spark, folder)[0]).select("run_id", "rows_processed", "health_score")


@query
def run_contracts(spark, folder):
    return history.violations(monthly_runs(spark, folder), history.run_violations())


@query
def result_contracts(spark, folder):
    return history.violations(monthly_results(spark, folder), history.result_violations())


# Jobs that write and read back -------------------------------------------------------------------

def _etl(spark: SparkSession, folder: str) -> tuple[HistoryStore, jobs.EtlResult]:
    root = workspace(spark, "etl")
    outcome = jobs.run_etl(spark, clean(spark, folder), root)
    if outcome.status != "SUCCESS":
        raise RuntimeError(f"{outcome.error_stage}: {outcome.error_message}")
    return HistoryStore(spark, root), outcome


@query
def etl_snapshot(spark, folder):
    """The published snapshot of a whole ETL run."""
    store, _ = _etl(spark, folder)
    return _shown_snapshot(store.snapshot().drop("transaction_id", "loaded_at"))


@query
def etl_run(spark, folder):
    """The stored run of an ETL job with the number of its findings."""
    store, outcome = _etl(spark, folder)
    per_run = history.results_per_run(store.results())
    return store.runs().join(per_run, "run_id").select(
        "run_id", "pipeline_name", "status", run_state(F.col("status")).alias("state"), "rows_processed",
        "health_score", "results_stored",
        F.lit(outcome.quality_failures).cast("bigint").alias("quality_failures"),
        F.lit(outcome.quality_warnings).cast("bigint").alias("quality_warnings"))


@query
def lineage_log(spark, folder):
    store, _ = _etl(spark, folder)
    return store.lineage().select("dataset_name", "stage", "rows")


@query
def stored_batches(spark, folder):
    """Every month validated, scored and stored as a run of its own, read back from the store."""
    store = HistoryStore(spark, workspace(spark, "history"))
    jobs.store_job(spark, monthly(spark, folder), store, by=RUN)
    return store.runs().select("run_id", "pipeline_name", "status", "rows_processed", "health_score")


@query
def compacted_batches(spark, folder):
    """Months stored in three batches, put together, and some of them removed."""
    store = HistoryStore(spark, workspace(spark, "history")).create()
    reports = stored(monthly_reports(spark, folder).select("run_id", "total_rows", "health_score", "results"), "reports")
    for i in range(3):
        store.save_runs(reports.filter(F.col("run_id") % 3 == i))
    store.compact()
    store.delete_runs([r["run_id"] for r in store.runs().filter("run_id % 5 = 0").select("run_id").collect()])
    return store.runs().join(history.results_per_run(store.results()), "run_id").select(
        "run_id", "rows_processed", "health_score", "results_stored")


# Report files, read back in their own order ------------------------------------------------------

@query
def profile_report(spark, folder):
    path = jobs.profile_job(spark, clean(spark, folder), workspace(spark, "profile"), row_key=measure.ROW)
    report = spark.read.schema(
        "columns array<struct<name:string,null_count:double>>, numeric array<struct<name:string,median:double>>,"
        " missing_per_column array<struct<name:string,missing_count:double>>,"
        " top_countries array<struct<country:string,rows:double>>,"
        " quality_flags array<struct<flag:string,note:string>>").json(path)

    def part(section: str, name: str, value: str) -> DataFrame:
        return report.select(F.posexplode(section).alias("position", "r")).select(
            F.lit(section).alias("section"), F.col("position").cast("bigint").alias("position"), F.col(f"r.{name}").alias("name"),
            F.expr(value).cast("double").alias("value"))

    return (part("columns", "name", "r.null_count").unionByName(part("numeric", "name", "r.median"))
            .unionByName(part("missing_per_column", "name", "r.missing_count"))
            .unionByName(part("top_countries", "country", "r.rows"))
            .unionByName(part("quality_flags", "flag", "if(r.note is null, 0, 1)")))


@query
def quality_report(spark, folder):
    path = jobs.validate_job(spark, faulty(spark, folder, grouped=True), workspace(spark, "quality"))
    report = spark.read.schema(
        "dataset_name string, duration_seconds double, total_rows bigint, summary struct<total_checks:bigint,failed:bigint>,"
        " results array<struct<check_name:string,status:string,affected_rows:bigint,affected_pct:double,affected_percentage:double>>").json(path)
    return report.select(
        "dataset_name", (F.col("duration_seconds") > 0).cast("bigint").alias("timed"), "total_rows", "summary.total_checks", "summary.failed",
        F.posexplode("results").alias("position", "r")).select(
        "*", "r.*").withColumn("position", F.col("position").cast("bigint")).drop("r")


@query
def score_report(spark, folder):
    path = jobs.score_job(spark, faulty(spark, folder, grouped=True), workspace(spark, "score"))
    report = spark.read.schema(
        "score double, status string, failure_reason string, dataset_name string,"
        " category_scores map<string,struct<score:double,max_score:double,details:string>>").json(path)
    return report.select("dataset_name", F.col("score").alias("health_score"), "status", "failure_reason",
                         F.explode("category_scores").alias("dimension", "d")).select("*", "d.*").drop("d")


@query
def lineage_sidecar(spark, folder):
    """The sidecar beside the published snapshot."""
    store, _ = _etl(spark, folder)
    output = store.lineage().filter("stage = 'load'").first()["path"]
    report = spark.read.schema(
        "dataset_name string, extraction struct<rows_extracted:bigint>, transformation struct<audit_log:map<string,string>>,"
        " load struct<output_path:string>").json(f"{output}.lineage.json")
    audit = F.col("transformation.audit_log")
    return report.select(
        "dataset_name", "extraction.rows_extracted", audit["rows_in"].cast("bigint").alias("rows_in"),
        audit["rows_out"].cast("bigint").alias("rows_out"), audit["columns_added"].alias("columns_added"),
        (F.col("load.output_path") == output).cast("bigint").alias("beside_its_output"))


@query
def csv_scan(spark, folder):
    """The table written as CSV and read with inferred types: values survive the round trip."""
    path = workspace(spark, "csv")
    clean(spark, folder).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    df = load_csv(spark, path)
    info = dataset_info(df)
    types = ",".join(f"{n}:{t}" for n, t in info["dtypes"].items())
    return df.groupBy(F.col("Country").alias("country")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("Quantity").alias("quantity"),
        F.count("CustomerID").alias("with_customer"), F.count("Description").alias("with_description"),
        F.min("InvoiceDate").alias("first_date"),
    ).withColumn("dtypes", F.lit(types))
