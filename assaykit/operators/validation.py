"""Run checks over a table, or over every batch of a table, as one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.values import nan_to_null, ref, text_literal
from assaykit.operators.checks import (
    FINDING_FIELDS, FINDING_TYPE, SORTABLE_FIELDS, Check, Counts, Finding, Outcome, Table, default_checks, finding_sql)
from assaykit.operators.measure import NONE, REPEATS, ROW, ROWS, measure
from assaykit.session import stored

RESULTS = "results"


def crashed(check: Check, error: BaseException) -> Finding:
    """The finding that stands for a check that could not run."""
    return Finding(check.name, check.category, (Outcome(
        "FAIL", "CRITICAL", f"The check could not run: {error}", rows=ROWS,
        percentage=f"if({ROWS} > 0, 100.0D, 0.0D)",
        metadata={"exception_type": text_literal(type(error).__name__)}),))


def validate(
    df: DataFrame,
    checks: Sequence[Check] | None = None,
    by: Sequence[str] = (),
    settings: Settings | None = None,
    row_key: str = ROW,
    broken: Mapping[int, BaseException] | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = stored,
) -> DataFrame:
    """Quality report: one row per ``by`` group (or one in all) with ``total_rows`` and ``results``.

    Lazy, one scan (but see ``measure`` for ``exact``). Findings stand in the order of the checks, those of a check in its own order. A check
    whose predicates, outcomes or frame cannot be planned, or whose position is in ``broken``, becomes one FAIL/CRITICAL finding
    at its place; use :func:`run_isolated` to catch checks that fail while running.
    """
    settings = settings or Settings()
    checks = list(default_checks(settings) if checks is None else checks)
    broken = dict(broken or {})
    df = nan_to_null(df)
    data_columns = [c for c in df.columns if c not in by]
    types = dict(df.dtypes)
    table = Table({c: types[c] for c in data_columns}, settings)

    predicates: dict[str, Column] = {}
    findings: dict[int, list[Finding]] = {}
    frames: dict[int, DataFrame] = {}
    repeats = False
    for i, check in enumerate(checks):
        prefix = f"__{i}_"
        if i in broken:
            findings[i] = [crashed(check, broken[i])]
            continue
        try:
            if check.frame is not None:
                frames[i] = _frame_findings(check.frame(df, list(by)), by, f"__list_{i}")
                continue
            wanted = {prefix + n: p for n, p in check.predicates(table).items()}
            made = list(check.findings(table, Counts(prefix)))
            df.select(*[p.alias(n) for n, p in wanted.items()])  # unknown columns surface here
        except Exception as error:
            findings[i] = [crashed(check, error)]
            continue
        predicates.update(wanted)
        findings[i] = made
        repeats = repeats or check.needs_repeats

    counted = measure(df, data_columns, predicates, by, row_key if repeats else NONE, stage)
    try:
        listed = {i: _list_sql(made) for i, made in findings.items()}
        counted.select(*map(F.expr, listed.values()))
    except Exception:  # an outcome that cannot be planned: look at each check on its own
        listed = {i: _planned(counted, checks[i], made) for i, made in findings.items()}
    keys = [ref(c) for c in by]
    if not frames:
        together = F.flatten(F.array(*[F.expr(listed[i]) for i in sorted(listed)])) if listed else F.expr(_list_sql([]))
        return counted.select(*keys, ROWS, REPEATS, together.alias(RESULTS))
    report = counted.select(*keys, ROWS, REPEATS, *[F.expr(sql).alias(f"__list_{i}") for i, sql in listed.items()])
    return _with_frames(report, frames, len(checks), list(by))


def _list_sql(findings: Sequence[Finding]) -> str:
    return f"cast(array_compact(array({', '.join(map(finding_sql, findings))})) as array<{FINDING_TYPE}>)"


def _planned(counted: DataFrame, check: Check, findings: Sequence[Finding]) -> str:
    """SQL of a check's findings, or of the finding that says why there is none."""
    try:
        sql = _list_sql(findings)
        counted.select(F.expr(sql))
        return sql
    except Exception as error:
        return _list_sql([crashed(check, error)])


def _findings_of(lists: Column) -> Column:
    """Findings from structs that lack the metadata."""
    return F.transform(F.coalesce(lists, F.array()), lambda x: F.struct(
        *[x[n].alias(n) for n in SORTABLE_FIELDS],
        F.create_map().cast("map<string,string>").alias("metadata"),
    ).cast(FINDING_TYPE))


def _frame_findings(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The finding rows of a check with a plan of its own as one list per batch.

    A ``finding_order`` column orders them, else their fields do; a ``metadata`` map is kept. A map cannot be ordered, so
    it travels as its entries.
    """
    keys = [ref(k) for k in by]
    order = ref("finding_order").cast("bigint") if "finding_order" in rows.columns else F.lit(0).cast("bigint")
    metadata = ref("metadata").cast("map<string,string>") if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        order.alias("finding_order"), *[ref(n).cast(FINDING_FIELDS[n]).alias(n) for n in SORTABLE_FIELDS],
        F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>"))).alias("metadata")))).alias(name))
    return listed.select(*keys, F.transform(name, lambda x: F.struct(
        *[x[n].alias(n) for n in SORTABLE_FIELDS], F.map_from_entries(x["metadata"]).alias("metadata")).cast(FINDING_TYPE)).alias(name))


def _with_frames(report: DataFrame, frames: Mapping[int, DataFrame], checks: int, by: list[str]) -> DataFrame:
    """All lists in the order of the checks.

    Every side has one row per batch and they meet by grouping, so a batch key may be null and a table
    without batches needs no join of single rows.
    """
    keys = [ref(k) for k in by]
    both = report
    for extra in frames.values():
        both = both.unionByName(extra, True)
    lists = [f"__list_{i}" for i in range(checks)]
    merged = both.groupBy(*keys).agg(*[F.any_value(c, True).alias(c) for c in (ROWS, REPEATS, *lists)])
    found = F.concat(*[F.coalesce(c, F.array().cast(f"array<{FINDING_TYPE}>")) for c in lists])
    return merged.filter(F.col(ROWS).isNotNull()).select(*keys, ROWS, REPEATS, found.alias(RESULTS))


def diagnose(
    df: DataFrame, checks: Sequence[Check], by: Sequence[str] = (), settings: Settings | None = None
) -> dict[int, BaseException]:
    """Run each check on its own and return the positions of those that fail, with their error."""
    failed: dict[int, BaseException] = {}
    for i, check in enumerate(checks):
        try:
            validate(df, [check], by, settings).write.format("noop").mode("overwrite").save()
        except Exception as error:
            failed[i] = error
    return failed


def run_isolated(
    df: DataFrame,
    action: Callable[[DataFrame], object],
    checks: Sequence[Check] | None = None,
    by: Sequence[str] = (),
    settings: Settings | None = None,
    row_key: str = ROW,
    stage: Callable[[DataFrame, str], DataFrame] = stored,
) -> object:
    """``action(report)``; if that fails, find the failing checks and act on a report that names them.

    The common case costs nothing extra. Only after a failure the checks run one at a time.
    """
    checks = list(default_checks(settings) if checks is None else checks)
    try:
        return action(validate(df, checks, by, settings, row_key, stage=stage))
    except Exception:
        failed = diagnose(df, checks, by, settings)
        if not failed:
            raise
        return action(validate(df, checks, by, settings, row_key, failed, stage))


def results(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The findings of a report as rows, numbered in report order.

    The outer form keeps the optimizer from filtering on the list before it is expanded, for which it
    would work out every finding twice; the row of an empty list is dropped afterwards.
    """
    rows = report.select(*[ref(c) for c in by], F.posexplode_outer(RESULTS).alias("check_order", "__r"))
    return rows.filter(F.col("check_order").isNotNull()).select(*[ref(c) for c in by], "check_order", "__r.*")


def as_records(rows: DataFrame) -> DataFrame:
    """Findings with the short alias of the percentage and the two outcome tests."""
    return rows.withColumns({
        "affected_pct": F.col("affected_percentage"),
        "passed": F.col("status") == "PASS",
        "failed": F.col("status") == "FAIL",
    })


def summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of findings per outcome."""
    def with_status(name: str, status: str) -> str:
        return f"cast(size(filter({RESULTS}, r -> r.status = '{status}')) as bigint) AS {name}"

    return report.select(
        *[ref(c) for c in by], ROWS, F.expr(f"cast(size({RESULTS}) as bigint) AS total_checks"),
        *[F.expr(with_status(n, s)) for n, s in (
            ("passed", "PASS"), ("warnings", "WARNING"), ("failed", "FAIL"), ("info", "INFO"))])


def acceptable_by_category(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per category: findings, passed ones, and those passed or informational."""
    return rows.groupBy(*[ref(c) for c in by], "category").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status").isin("PASS", "INFO")).alias("acceptable"),
    )


def report_from_results(rows: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reports rebuilt from stored findings; a run without findings keeps an empty report.

    A list holds the findings of one run, so its length is the number of checks, not of rows.
    """
    lists = rows.groupBy(*[ref(c) for c in by]).agg(
        F.array_sort(F.collect_list(F.struct("check_order", *SORTABLE_FIELDS))).alias("__list"))
    joined = runs.join(lists, list(by), "left")
    return joined.withColumn(RESULTS, _findings_of(F.col("__list"))).drop("__list")
