"""Report files, the lineage sidecar and the database sink."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.values import ref
from assaykit.operators.validation import RESULTS, summary

INSERT_BATCH = 10_000
NULLS_KEPT = {"ignoreNullFields": "false"}


def stamp() -> str:
    """Compact UTC time used in file names and lineage numbers."""
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def write_json(documents: DataFrame, path: str | None = None, kind: str = "report") -> str:
    """Write JSON documents (one text column) as a folder of JSON lines."""
    path = path or f"{Settings.from_env().reports_path}/{kind}_{stamp()}.json"
    documents.write.mode("overwrite").text(path)
    return path


def quality_document(report: DataFrame, dataset_name: str, duration_seconds: float | None = None) -> DataFrame:
    """Quality reports as JSON texts, with summary and both names of the percentage."""
    keys = [c for c in report.columns if c not in ("total_rows", "repeated_rows", RESULTS)]
    counts = summary(report.withColumn("__r", F.col(RESULTS)), [*keys, "__r"])
    listed = F.transform("__r", lambda r: F.struct(
        r["check_name"].alias("check_name"), r["category"].alias("category"), r["status"].alias("status"),
        r["severity"].alias("severity"), r["message"].alias("message"),
        r["affected_rows"].alias("affected_rows"), r["affected_percentage"].alias("affected_pct"),
        r["metadata"].alias("metadata"), r["affected_percentage"].alias("affected_percentage")))
    return counts.select(F.to_json(F.struct(
        *[ref(k) for k in keys],
        F.lit(dataset_name).alias("dataset_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("validated_at"),
        F.lit(duration_seconds).cast("double").alias("duration_seconds"),
        "total_rows",
        F.struct("total_checks", "passed", "warnings", "failed", "info").alias("summary"),
        listed.alias("results"),
    ), NULLS_KEPT).alias("value"))


def score_document(scored: DataFrame, dataset_name: str) -> DataFrame:
    """Scored reports as JSON texts."""
    keys = [c for c in scored.columns if c not in (
        "total_rows", "repeated_rows", RESULTS, "category_scores", "health_score", "health_label",
        "failure_reason")]
    by_name = F.map_from_entries(F.transform("category_scores", lambda d: F.struct(
        d["dimension"], F.struct(
            d["score"].alias("score"), d["max_score"].alias("max_score"), d["details"].alias("details"),
            d["included_checks"].alias("included_checks")))))
    return scored.select(F.to_json(F.struct(
        *[ref(k) for k in keys],
        F.col("health_score").alias("score"), F.col("health_label").alias("status"),
        by_name.alias("category_scores"), F.lit(dataset_name).alias("dataset_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("validated_at"),
        "failure_reason",
        F.struct(F.lit(1.0).alias("PASS"), F.lit(1.0).alias("INFO"), F.lit(0.5).alias("WARNING"),
                 F.lit(0.0).alias("FAIL")).alias("scoring_rules"),
    ), NULLS_KEPT).alias("value"))


def lineage_document(lineage: DataFrame) -> DataFrame:
    """One JSON text per lineage record, with the three stages under their names."""
    def stage(name: str, *fields) -> Column:
        record = F.struct(F.col("recorded_at").alias("timestamp_utc"), *fields)
        return F.any_value(F.when(F.col("stage") == name, record), True).alias(name)

    records = lineage.groupBy("dataset_name", "lineage_id").agg(
        stage("extraction", F.col("path").alias("source_path"), F.col("rows").alias("rows_extracted")),
        stage("transformation", F.col("audit").alias("audit_log")),
        stage("load", F.col("path").alias("output_path")),
    )
    return records.select(F.to_json(F.struct(*records.columns), NULLS_KEPT).alias("value"))


def write_lineage_sidecar(lineage: DataFrame, output_path: str | None) -> str:
    """Write the record beside its output, as ``<name>.lineage.json``."""
    if not output_path:
        raise ValueError("Cannot save lineage: output_path has not been recorded.")
    folder, _, name = output_path.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return write_json(lineage_document(lineage), f"{folder}/{stem}.lineage.json" if folder else f"{stem}.lineage.json")


def replace_database_table(rows: DataFrame, url: str, table: str, batch_size: int = INSERT_BATCH,
                           **options: str) -> None:
    """Replace the content of a database table, in batches, keeping its definition."""
    rows.write.format("jdbc").options(
        url=url, dbtable=table, truncate="true", batchsize=str(batch_size), **options).mode("overwrite").save()
