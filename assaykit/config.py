"""Contract, thresholds and weights. Every value can be replaced per call or by environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# The source contract, in column order, with its Spark types.
RETAIL_COLUMNS = {
    "InvoiceNo": "string",
    "StockCode": "string",
    "Description": "string",
    "Quantity": "bigint",
    "InvoiceDate": "string",
    "UnitPrice": "double",
    "CustomerID": "double",
    "Country": "string",
}

# What a null in a column means; every other column fails.
# column -> (status, severity, sentence added to the message)
NULL_POLICY = {
    "CustomerID": ("INFO", "INFO", " This is expected for guest transactions."),
    "Description": ("WARNING", "LOW", ""),
}
NULL_POLICY_DEFAULT = ("FAIL", "HIGH", "")

# Points of the five score dimensions.
SCORE_WEIGHTS = {
    "completeness": 20.0,
    "validity": 20.0,
    "uniqueness": 20.0,
    "schema": 20.0,
    "business_rules": 20.0,
}

# Texts that a CSV reader with pandas' defaults takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The two label vocabularies, as (lowest score, label), best first.
DASHBOARD_LABELS = ((90.0, "Excellent"), (75.0, "Good"), (50.0, "Poor"))


def _env_float(name: str, default: float) -> float:
    return float(os.getenv(name, default))


@dataclass(frozen=True)
class Settings:
    """One set of rules. ``Settings.from_env()`` lets environment variables override the defaults."""

    columns: dict[str, str] = field(default_factory=lambda: dict(RETAIL_COLUMNS))
    unexpected_column_limit: int = 3
    healthy_from: float = 90.0
    warning_from: float = 75.0
    poor_from: float = 50.0
    weights: dict[str, float] = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    null_tokens: tuple[str, ...] = NULL_TOKENS
    extra_date_formats: tuple[str, ...] = ()
    raw_data_path: str = "data/raw/online_retail.csv"
    reports_path: str = "reports"

    @classmethod
    def from_env(cls) -> Settings:
        return cls(
            unexpected_column_limit=int(os.getenv("UNEXPECTED_COLUMN_WARNING_COUNT", 3)),
            healthy_from=_env_float("QUALITY_THRESHOLD_WARNING", 90),
            warning_from=_env_float("QUALITY_THRESHOLD_POOR", 75),
            poor_from=_env_float("QUALITY_THRESHOLD_CRITICAL", 50),
            raw_data_path=os.getenv("RAW_DATA_PATH", "data/raw/online_retail.csv"),
            reports_path=os.getenv("REPORTS_PATH", "reports"),
        )

    @property
    def labels(self) -> tuple[tuple[float, str], ...]:
        return (
            (self.healthy_from, "Healthy"),
            (self.warning_from, "Warning"),
            (self.poor_from, "Poor"),
        )
