"""Data-quality checks, health scores and run history for tables, on Spark DataFrames."""

from assaykit.config import Settings
from assaykit.operators.checks import Check, default_checks
from assaykit.operators.profiling import profile
from assaykit.operators.scoring import category_scores, score
from assaykit.operators.transform import transform
from assaykit.operators.validation import results, summary, validate
from assaykit.session import get_spark, workspace
from assaykit.sources.readers import dataset_info, load_csv, load_excel, load_parquet
from assaykit.sources.store import HistoryStore

__all__ = [
    "Check",
    "HistoryStore",
    "Settings",
    "category_scores",
    "dataset_info",
    "default_checks",
    "get_spark",
    "load_csv",
    "load_excel",
    "load_parquet",
    "profile",
    "results",
    "score",
    "summary",
    "transform",
    "validate",
    "workspace",
]
