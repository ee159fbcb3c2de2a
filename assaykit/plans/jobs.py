"""Jobs from a source to its reports, stored history and published snapshot.

Jobs that have written their table as Parquet (profile, ETL) find repeated rows by digests first (``exact``). The others read a source
that may be text or an expensive view, so their default is one pass over it (``row``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from time import perf_counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.values import nan_to_null
from assaykit.operators import transform as tf
from assaykit.operators.checks import Check
from assaykit.operators.measure import EXACT, ROW
from assaykit.operators.profiling import profile, profile_document
from assaykit.operators.scoring import score
from assaykit.operators.validation import run_isolated, summary
from assaykit.session import Staging
from assaykit.sources.readers import POSITION, Extraction, extract_csv
from assaykit.sources.sinks import (
    quality_document, score_document, stamp, write_json, write_lineage_sidecar)
from assaykit.sources.store import HistoryStore

DATASET = "Online Retail"


@dataclass
class EtlResult:
    """Outcome of one ETL run; a failed one names its stage."""

    pipeline_name: str
    status: str
    started_at: datetime
    finished_at: datetime
    duration_seconds: float
    rows_extracted: int = 0
    rows_transformed: int = 0
    rows_loaded: int = 0
    health_score: float | None = None
    quality_failures: int = 0
    quality_warnings: int = 0
    run_id: int | None = None
    error_stage: str | None = None
    error_message: str | None = None


def _extract(spark: SparkSession, source: DataFrame | str, keep_order: bool = False,
             settings: Settings | None = None) -> Extraction:
    if isinstance(source, DataFrame):
        return Extraction(source, "dataframe", None, len(source.columns), 0.0)
    return extract_csv(spark, str(source), keep_order=keep_order, settings=settings)


def profile_job(spark: SparkSession, source: DataFrame | str, output: str | None = None,
                dataset: str = DATASET, settings: Settings | None = None, row_key: str = EXACT) -> str:
    """Profile a source and write the report; samples come in file order for a CSV path.

    The source is worked out once and written as columns, whether it is text or a view with joins: three passes read it. Figures
    and distinct values are then stored for the sections that share them.
    """
    with Staging(spark) as stage:
        extraction = _extract(spark, source, keep_order=True, settings=settings)
        df = stage(extraction.df, "profile-source")
        order = POSITION if POSITION in df.columns else None
        sections = profile(df, settings, row_key, order, stage)
        return write_json(profile_document(sections, dataset), output, "profile")


def validate_job(spark: SparkSession, source: DataFrame | str, output: str | None = None,
                 dataset: str = DATASET, checks: Sequence[Check] | None = None, by: Sequence[str] = (),
                 settings: Settings | None = None, row_key: str = ROW) -> str:
    """Validate a source, or each of its batches, and write the quality report with the seconds that the checks took."""
    with Staging(spark) as stage:
        df = _extract(spark, source, settings=settings).df
        timer = perf_counter()
        report = run_isolated(df, lambda r: stage(r, "quality"), checks, by, settings, row_key, stage)
        return write_json(quality_document(report, dataset, round(perf_counter() - timer, 4)), output, "quality")


def score_job(spark: SparkSession, source: DataFrame | str, output: str | None = None,
              dataset: str = DATASET, checks: Sequence[Check] | None = None, by: Sequence[str] = (),
              settings: Settings | None = None, row_key: str = ROW) -> str:
    """Validate and score, and write the score report."""
    output = output or f"{(settings or Settings.from_env()).reports_path}/health_score_latest.json"
    with Staging(spark) as stage:
        df = _extract(spark, source, settings=settings).df
        return run_isolated(
            df, lambda report: write_json(score_document(score(report, settings), dataset), output),
            checks, by, settings, row_key, stage)


def store_job(spark: SparkSession, source: DataFrame | str, store: HistoryStore,
              pipeline_name: str = "online_retail_quality_pipeline", checks: Sequence[Check] | None = None,
              by: Sequence[str] = (), settings: Settings | None = None, row_key: str = ROW) -> DataFrame:
    """Validate, score and store one run, or one run per batch if ``by`` is ``["run_id"]``."""
    started = datetime.now(timezone.utc)
    store.create()
    try:
        df = _extract(spark, source, settings=settings).df
        report = run_isolated(df, lambda r: store.stage(r, "quality"), checks, by, settings, row_key, store.stage)
        return store.save_runs(score(report, settings), pipeline_name, started, datetime.now(timezone.utc))
    finally:
        store.clear()


def lineage_rows(spark: SparkSession, dataset: str, lineage_id: str, source: str, extracted: int,
                 extracted_at: datetime, audit: dict[str, str], transformed: int, transformed_at: datetime,
                 output: str, loaded: int, loaded_at: datetime) -> DataFrame:
    """The three lineage records of one run."""
    pairs = [F.lit(str(x)) for kv in audit.items() for x in kv]

    def record(stage, at, path, rows, details):
        return F.struct(
            F.lit(lineage_id).alias("lineage_id"), F.lit(dataset).alias("dataset_name"),
            F.lit(stage).alias("stage"), F.lit(at).alias("recorded_at"),
            F.lit(path).cast("string").alias("path"), F.lit(rows).cast("bigint").alias("rows"),
            F.create_map(*details).cast("map<string,string>").alias("audit"))

    return spark.range(1).select(F.inline(F.array(
        record("extraction", extracted_at, source, extracted, []),
        record("transformation", transformed_at, None, transformed, pairs),
        record("load", loaded_at, output, loaded, []),
    )))


def run_etl(spark: SparkSession, source: DataFrame | str, root: str,
            pipeline_name: str = "online_retail_etl", dataset: str = DATASET,
            checks: Sequence[Check] | None = None, settings: Settings | None = None,
            row_key: str = EXACT) -> EtlResult:
    """Extract, transform, load, validate, score, persist. Findings never fail a run, errors do.

    One pass over the source writes the staged snapshot and counts extracted rows, values that
    cannot be transformed and missing values that cannot be stored. The checks then read the
    staged Parquet. The snapshot becomes current when the run is committed, so a failure at any
    stage leaves the old one in place; what the failed run had written is deleted.
    """
    started, timer = datetime.now(timezone.utc), perf_counter()
    counts = {"extracted": 0, "transformed": 0, "loaded": 0}
    stage, store, path = "EXTRACT", None, None
    try:
        extraction = _extract(spark, source, settings=settings)
        counts["extracted"] = extraction.rows or 0
        extracted_at = datetime.now(timezone.utc)

        stage = "TRANSFORM"
        tf.require(extraction.df, tf.REQUIRED, "transform dataset", tf.TransformationError)
        raw = nan_to_null(extraction.df)
        seen = Observation()
        watched = raw.observe(seen, F.count(F.lit(1)).alias("rows"),
                              *[c.alias(n) for n, c in tf.problems(raw, settings).items()])
        transformed = tf.transform(watched, settings, tf.number_kinds(raw))

        stage = "LOAD"
        store = HistoryStore(spark, root).create()
        run_id = store.next_run_id()
        path = store.snapshot_path(run_id)
        sent = store.stage_snapshot(transformed, path)
        found = seen.get
        counts["extracted"] = found["rows"]
        message = tf.problem_message(found)
        if message:
            stage = "TRANSFORM"
            raise tf.TransformationError(message)
        counts["transformed"] = sent["rows_loaded"]
        transformed_at = datetime.now(timezone.utc)
        staged = store.verify_snapshot(path, sent)
        counts["loaded"] = sent["rows_loaded"]
        loaded_at = datetime.now(timezone.utc)

        stage = "VALIDATE"
        if set(transformed.columns) == set(tf.SNAPSHOT_COLUMNS):
            frame = tf.from_snapshot(staged, dict(transformed.dtypes)).select(*transformed.columns)
        else:  # further source columns are validated but not stored
            frame = tf.transform(raw, settings, tf.number_kinds(raw))
        report = run_isolated(frame, lambda r: store.stage(r, "quality"), checks, (), settings, row_key, store.stage)

        stage = "SCORE"
        scored = score(report, settings)

        stage = "PERSIST"
        audit = {"rows_in": counts["extracted"], "rows_out": counts["transformed"],
                 "columns_added": "IsCancellation, Revenue", "rows_removed": 0}
        lineage = lineage_rows(spark, dataset, stamp(), extraction.source, counts["extracted"], extracted_at,
                               audit, counts["transformed"], transformed_at, path, counts["loaded"], loaded_at)
        write_lineage_sidecar(lineage, path)
        totals, health_score = summary(report).first(), scored.first()["health_score"]
        store.save_runs(scored.withColumn("run_id", F.lit(run_id).cast("bigint")), pipeline_name, started,
                        datetime.now(timezone.utc), "SUCCESS", (path, counts["loaded"]), lineage)  # the last step that can fail
        path = None
        return EtlResult(
            pipeline_name, "SUCCESS", started, datetime.now(timezone.utc), round(perf_counter() - timer, 4),
            counts["extracted"], counts["transformed"], counts["loaded"], health_score,
            totals["failed"], totals["warnings"], run_id)
    except Exception as error:
        return EtlResult(
            pipeline_name, "FAILED", started, datetime.now(timezone.utc), round(perf_counter() - timer, 4),
            counts["extracted"], counts["transformed"], counts["loaded"], error_stage=stage,
            error_message=str(error))
    finally:
        if store is not None:
            store.clear()
            if path is not None:
                store.discard_snapshot(path)
