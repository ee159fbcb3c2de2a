"""Queries over stored runs and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.operators.checks import SORTABLE_FIELDS
from assaykit.operators.scoring import dashboard_label, run_state

# Stored columns, in the order of the reports.
RUN_COLUMNS = ("run_id", "pipeline_name", "started_at", "finished_at", "duration_seconds", "status",
               "rows_processed", "health_score")
RESULT_COLUMNS = ("result_id", "run_id", "check_name", "category", "status", "severity", "affected_rows",
                  "affected_percentage", "message", "created_at")
DISPLAY_COLUMNS = ("check_name", "category", "status", "severity", "affected_rows", "affected_percentage",
                   "message")
HISTORY_COLUMNS = ("run_id", "pipeline_name", "started_at", "status", "rows_processed", "duration_seconds",
                   "health_score")
MAX_CHECKS = 1_000_000
RUN_BLOCK = 10_000


def result_id(run_id: Column, check_order: Column) -> Column:
    """Key of a finding: grows with the run, then with the order of the checks, without a global sort."""
    return run_id * MAX_CHECKS + check_order + 1


def available(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The wanted columns that exist, in that order."""
    return df.select(*[c for c in wanted if c in df.columns])


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError(f"at least one row must be asked for, not {limit}")
    return limit


# Runs --------------------------------------------------------------------------------------------

def all_runs(runs: DataFrame) -> DataFrame:
    return available(runs, RUN_COLUMNS).orderBy("run_id")


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest runs first."""
    return available(runs, RUN_COLUMNS).orderBy(F.desc("run_id")).limit(_positive(limit))


def latest_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def score_history(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The last runs, oldest first."""
    return recent_runs(runs, limit).orderBy("run_id")


def run_history(runs: DataFrame) -> DataFrame:
    return available(runs, HISTORY_COLUMNS).withColumn(
        "started_at", F.col("started_at").cast("timestamp")).orderBy("run_id")


def score_trend(runs: DataFrame) -> DataFrame:
    """Scores over time with the dashboard's label and state of each run."""
    return runs.select(
        "run_id", "started_at", "health_score",
        dashboard_label(F.col("health_score")).alias("label"), run_state(F.col("status")).alias("state"),
    ).orderBy("run_id")


def run_series(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "duration_seconds", "rows_processed").orderBy("run_id")


def _with_previous(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the score of the run before, found without ordering all runs in one task.

    Runs are cut into blocks of numbers. Inside a block the previous run is a window; the first run
    of a block takes the last score of the block before, and there is one such row per block.
    """
    blocks = runs.withColumn("block", F.expr(f"run_id div {RUN_BLOCK}"))
    inside = Window.partitionBy(*keys, "block").orderBy("run_id")
    series = Window.partitionBy(*keys).orderBy("block")
    carried = blocks.groupBy(*keys, "block").agg(F.max_by("health_score", "run_id").alias("last")).select(
        *keys, "block", F.lag("last").over(series).alias("carried"))
    scored = blocks.withColumns({
        "before": F.lag("health_score").over(inside), "place": F.row_number().over(inside)})
    return scored.join(carried, [*keys, "block"]).withColumn(
        "previous_score", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("before")))


def score_delta(runs: DataFrame, per_name: bool = False) -> DataFrame:
    """Score change against the previous run, null for the first one.

    Partitioning by name keeps several jobs apart; without it all runs form one series, as they do
    on a run list.
    """
    columns = runs.select("run_id", "pipeline_name", "health_score")
    delta = F.round(F.col("health_score") - F.col("previous_score"), 2)
    return _with_previous(columns, ["pipeline_name"] if per_name else []).select(
        "run_id", "pipeline_name", "health_score", "previous_score", delta.alias("score_delta"),
        F.when(delta > 0, "↑").when(delta < 0, "↓").when(delta == 0, "→").alias("direction"))


def latest_run_info(runs: DataFrame) -> DataFrame:
    """The newest run as metric and value rows."""
    info = latest_run(runs).select(
        F.col("run_id").cast("string").alias("Run ID"),
        F.col("pipeline_name").alias("Pipeline"),
        F.col("status").alias("Status"),
        F.format_number("rows_processed", 0).alias("Rows Processed"),
        F.concat(F.format_string("%.2f", "duration_seconds"), F.lit(" sec")).alias("Duration"),
        F.concat(F.format_string("%.2f", "health_score"), F.lit("/100")).alias("Health Score"),
    )
    return info.unpivot([], info.columns, "metric", "value")


# Findings ----------------------------------------------------------------------------------------

def all_results(results: DataFrame) -> DataFrame:
    return available(results, RESULT_COLUMNS).orderBy("result_id")


def results_of(results: DataFrame, run_id: int) -> DataFrame:
    """Findings of one run; reads only its partition."""
    return results.filter(F.col("run_id") == run_id).orderBy("result_id")


def with_status(results: DataFrame, status: str, run_id: int | None = None) -> DataFrame:
    found = results.filter(F.col("status") == status)
    if run_id is not None:
        found = found.filter(F.col("run_id") == run_id)
    return found.orderBy("result_id")


def failed_checks(results: DataFrame, run_id: int | None = None) -> DataFrame:
    return with_status(results, "FAIL", run_id)


def warning_checks(results: DataFrame, run_id: int | None = None) -> DataFrame:
    return with_status(results, "WARNING", run_id)


def newest_run_id(runs: DataFrame) -> int | None:
    """Highest run number, looked up at once; null without runs."""
    return runs.agg(F.max("run_id").alias("run_id")).first()["run_id"]


def latest_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of the newest run. Its number goes into the plan as a literal, so only its partition is read."""
    return results.filter(F.col("run_id") == F.lit(newest_run_id(runs)).cast("bigint"))


def latest_details(results: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_results(results, runs).orderBy("result_id").select(
        *[c for c in DISPLAY_COLUMNS if c in results.columns])


def attention(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures of the newest run, then its warnings."""
    return latest_results(results, runs).filter(F.col("status").isin("FAIL", "WARNING")).select(
        "status", "check_name", "message", "result_id").orderBy("status", "result_id")


def status_mix(results: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_results(results, runs).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def category_status(results: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_results(results, runs).groupBy("category", "status").agg(F.count(F.lit(1)).alias("checks"))


def latest_cards(results: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_results(results, runs).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"))


def results_per_run(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("results_stored"))


# Runs and findings together ----------------------------------------------------------------------

def runs_with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with the list of its findings; a list is as long as a run has checks."""
    lists = results.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("result_id", *SORTABLE_FIELDS))).alias("quality_results"))
    return runs.join(lists, "run_id", "left")


def run_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Findings next to the data of their run."""
    parent = runs.select("run_id", "pipeline_name", "health_score", F.col("status").alias("run_status"))
    return results.join(parent, "run_id")


def orphan_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings without a run; must be empty."""
    return results.join(runs.select("run_id"), "run_id", "left_anti")


def without_runs(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of runs or findings that stay when runs are removed."""
    return df.join(removed.select("run_id"), "run_id", "left_anti")


# Contracts ---------------------------------------------------------------------------------------

def run_violations() -> dict[str, Column]:
    """Aggregates that count run rows out of range."""
    return {
        "duration_negative": F.count_if(~(F.col("duration_seconds") >= 0)),
        "rows_negative": F.count_if(~(F.col("rows_processed") >= 0)),
        "score_out_of_range": F.count_if(~F.col("health_score").between(0, 100)),
        "run_nulls": F.count_if(
            F.col("run_id").isNull() | F.col("pipeline_name").isNull() | F.col("started_at").isNull()
            | F.col("duration_seconds").isNull() | F.col("status").isNull()
            | F.col("rows_processed").isNull() | F.col("health_score").isNull()),
    }


def result_violations() -> dict[str, Column]:
    """Aggregates that count findings out of range or outside the known outcomes."""
    return {
        "rows_negative": F.count_if(~(F.col("affected_rows") >= 0)),
        "percentage_out_of_range": F.count_if(~F.col("affected_percentage").between(0, 100)),
        "unknown_status": F.count_if(~F.col("status").isin("PASS", "WARNING", "FAIL", "INFO")),
        "unknown_severity": F.count_if(~F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")),
        "result_nulls": F.count_if(
            F.col("run_id").isNull() | F.col("check_name").isNull() | F.col("category").isNull()
            | F.col("status").isNull() | F.col("severity").isNull() | F.col("affected_rows").isNull()
            | F.col("affected_percentage").isNull() | F.col("message").isNull()),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of violations of each rule; one pass, no shuffle of rows."""
    return df.agg(*[c.alias(n) for n, c in rules.items()])


# SQL ---------------------------------------------------------------------------------------------

def run_query(spark: SparkSession, query: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Result of a parameterised SELECT. ``tables`` are put in as ``{name}``, parameters as ``:name``."""
    first = query.lstrip(" \t\r\n(").split(None, 1)[0].upper()
    if first not in ("SELECT", "WITH", "FROM", "VALUES"):
        raise ValueError("only read queries are allowed")
    return spark.sql(query, args=params or {}, **tables)
