"""Health score of quality reports: row-local, so it scores one report or all stored ones alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.config import DASHBOARD_LABELS, Settings
from assaykit.functions.values import ref, text_literal
from assaykit.operators.validation import RESULTS

CRITICAL_REASON = "CRITICAL SCHEMA FAILURE"
NOT_ASSESSED = "No validation results available for this dimension."
# The rule that is its own dimension, and the points of each outcome.
BUSINESS_RULE = "quantity_cancellation_logic"
POINTS = {"PASS": 1.0, "INFO": 1.0, "WARNING": 0.5, "FAIL": 0.0}


def points(status: str) -> str:
    """SQL of the points of a status."""
    whens = " ".join(f"WHEN '{s}' THEN {p}D" for s, p in POINTS.items())
    return f"CASE {status} {whens} ELSE 0.0D END"


def dimension(result: str) -> str:
    """SQL of the score dimension of a finding."""
    return f"if({result}.check_name = '{BUSINESS_RULE}', 'business_rules', coalesce({result}.category, 'unknown'))"


def label(value: Column, cuts: Sequence[tuple[float, str]]) -> Column:
    """First label whose lowest score is reached, else Critical."""
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for lowest, text in cuts[1:]:
        out = out.when(value >= lowest, text)
    return out.otherwise("Critical")


def dashboard_label(value: Column) -> Column:
    return label(value, DASHBOARD_LABELS)


def run_state(status: Column) -> Column:
    """State shown for a run. Both stored outcomes of a finished run count as healthy."""
    return (
        F.when(status.isin("SUCCESS", "COMPLETED"), "healthy")
        .when(status == "WARNING", "warning")
        .otherwise("failed")
    )


def _dimension_score(name: str, weight: float) -> str:
    """SQL of the score of one dimension, from ``graded`` findings and the ``critical`` gate."""
    checks = f"filter(graded, g -> g.dimension = {text_literal(name)})"
    earned = f"aggregate({checks}, 0.0D, (total, g) -> total + g.points)"
    included = f"transform({checks}, g -> struct(g.check_name, g.status, g.points))"
    return (
        f"named_struct('dimension', {text_literal(name)},"
        f" 'score', CASE WHEN critical OR size({checks}) = 0 THEN 0.0D"
        f" ELSE round({earned} / size({checks}) * {float(weight)}D, 2) END,"
        f" 'max_score', {float(weight)}D,"
        f" 'details', CASE WHEN critical THEN '{CRITICAL_REASON}' WHEN size({checks}) = 0 THEN '{NOT_ASSESSED}'"
        f" ELSE concat({earned}, '/', size({checks}), ' rule points earned.') END,"
        f" 'included_checks', if(critical, filter({included}, c -> false), {included}))"
    )


def score(report: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Reports with ``health_score``, ``health_label``, ``failure_reason`` and ``category_scores``."""
    settings = settings or Settings()
    graded = report.select(
        "*",
        F.expr(f"""transform({RESULTS}, r -> named_struct(
            'dimension', {dimension('r')}, 'check_name', coalesce(r.check_name, 'unnamed_check'),
            'status', coalesce(r.status, 'UNKNOWN'), 'points', {points('r.status')}))""").alias("graded"),
        F.expr(f"""exists({RESULTS}, r -> coalesce(
            r.category = 'schema' AND r.status = 'FAIL' AND r.severity = 'CRITICAL', false))""").alias("critical"),
    )
    dimensions = ", ".join(_dimension_score(n, w) for n, w in settings.weights.items())
    scored = graded.select(
        *[ref(c) for c in report.columns], "critical", F.expr(f"array({dimensions})").alias("category_scores"))
    total = F.expr("round(aggregate(category_scores, 0.0D, (total, d) -> total + d.score), 2)")
    return scored.select("*", total.alias("health_score")).select(
        *[ref(c) for c in report.columns], "category_scores", "health_score",
        F.when(F.col("critical"), "Critical").otherwise(
            label(F.col("health_score"), settings.labels)).alias("health_label"),
        F.when(F.col("critical"), CRITICAL_REASON).alias("failure_reason"))


def category_scores(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per dimension of each scored report.

    The outer form keeps the optimizer from filtering on the list, for which it would work it out twice.
    """
    return scored.select(*[ref(c) for c in by], F.inline_outer("category_scores"))
