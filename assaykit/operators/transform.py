"""Lossless transform of the source and its projection to the stored snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.dates import iso_text, parse_date
from assaykit.functions.values import INTEGER_TEXT, is_number, nan_to_null, ref, to_number
from assaykit.operators.checks import cancelled

REQUIRED = ("InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice")
# Transformed column -> snapshot column, in snapshot order.
SNAPSHOT_COLUMNS = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
    "IsCancellation": "is_cancellation",
    "Revenue": "revenue",
}
NOT_NULL = ("invoice_no", "stock_code", "quantity", "invoice_date", "unit_price", "is_cancellation", "revenue")


class TransformationError(ValueError):
    """The source cannot be transformed without losing or inventing values."""


def require(df: DataFrame, columns: Sequence[str], what: str, error: type[Exception] = ValueError) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"Cannot {what}; missing columns: {missing}")


def _number(df: DataFrame, name: str, kinds: dict[str, str]) -> Column:
    dtype = dict(df.dtypes)[name]
    if dtype == "boolean" or not is_number(dtype):
        return to_number(name, dtype).cast(kinds.get(name, "double"))
    return ref(name)


def transform(df: DataFrame, settings: Settings | None = None,
              kinds: dict[str, str] | None = None) -> DataFrame:
    """All rows and columns, with numbers, ISO dates, ``IsCancellation`` and ``Revenue``.

    A narrow projection: no filter, no shuffle. Text that is no number or no date becomes null
    here; :func:`require_transformable` or the counts of :func:`problems` report such rows.
    """
    require(df, REQUIRED, "transform dataset", TransformationError)
    settings, kinds = settings or Settings(), kinds or {}
    df = nan_to_null(df)
    date = parse_date(ref("InvoiceDate"), dict(df.dtypes)["InvoiceDate"], settings.extra_date_formats)
    typed = df.withColumns({
        "Quantity": _number(df, "Quantity", kinds),
        "UnitPrice": _number(df, "UnitPrice", kinds),
        "InvoiceDate": iso_text(date),
    })
    return typed.withColumns({
        "IsCancellation": cancelled(),
        "Revenue": ref("Quantity") * ref("UnitPrice"),
    })


def problems(df: DataFrame, settings: Settings | None = None) -> dict[str, Column]:
    """Aggregates over the source that count the values a transform would lose."""
    settings = settings or Settings()
    types = dict(df.dtypes)
    counts = {
        f"bad_{n}": F.count_if(ref(n).isNotNull() & to_number(n, types[n]).isNull())
        for n in ("Quantity", "UnitPrice")
    }
    date = parse_date(ref("InvoiceDate"), types["InvoiceDate"], settings.extra_date_formats)
    counts["bad_InvoiceDate"] = F.count_if(ref("InvoiceDate").isNotNull() & date.isNull())
    return counts


def problem_message(counts: dict[str, int]) -> str | None:
    """Why the transform must fail, or None."""
    numbers = [f"{n} has {counts[f'bad_{n}']}" for n in ("Quantity", "UnitPrice") if counts[f"bad_{n}"]]
    if numbers:
        return f"Unable to normalize numeric fields: {', '.join(numbers)} non-numeric value(s)."
    if counts["bad_InvoiceDate"]:
        return f"InvoiceDate contains {counts['bad_InvoiceDate']} unparseable non-null value(s)."
    return None


def number_kinds(df: DataFrame) -> dict[str, str]:
    """Type of number columns that arrive as text: whole if every value is, else real. One pass."""
    texts = [n for n in ("Quantity", "UnitPrice") if dict(df.dtypes)[n] == "string"]
    if not texts:
        return {}
    row = df.agg(*[F.count_if(~ref(n).rlike(INTEGER_TEXT) | ref(n).isNull()).alias(n) for n in texts]).first()
    return {n: "bigint" if row[n] == 0 else "double" for n in texts}


def require_transformable(df: DataFrame, settings: Settings | None = None) -> None:
    """Eager check, one pass without a shuffle, for callers that do not write the result themselves."""
    require(df, REQUIRED, "transform dataset", TransformationError)
    df = nan_to_null(df)
    row = df.agg(*[c.alias(n) for n, c in problems(df, settings).items()]).first()
    message = problem_message(row.asDict())
    if message:
        raise TransformationError(message)


def to_snapshot(transformed: DataFrame) -> DataFrame:
    """The ten stored columns. Missing text stays null and is caught by the NOT NULL rule."""
    require(transformed, list(SNAPSHOT_COLUMNS), "load transformed data")
    df = nan_to_null(transformed)
    casts = {
        "InvoiceNo": "string", "StockCode": "string", "Quantity": "double", "UnitPrice": "double",
        "CustomerID": "double", "Revenue": "double",
    }
    columns = []
    for source, target in SNAPSHOT_COLUMNS.items():
        value = ref(source)
        if source == "InvoiceDate":
            value = value.try_cast("timestamp_ntz")
        elif source in casts:
            value = value.cast(casts[source])
        columns.append(value.alias(target))
    return df.select(*columns)


def from_snapshot(snapshot: DataFrame, types: dict[str, str]) -> DataFrame:
    """The transformed table again, read from its snapshot, with the types it had."""
    columns = []
    for source, target in SNAPSHOT_COLUMNS.items():
        value = iso_text(ref(target)) if source == "InvoiceDate" else ref(target).cast(types[source])
        columns.append(value.alias(source))
    return snapshot.select(*columns)


def null_violations() -> dict[str, Column]:
    """Aggregates over a snapshot that count nulls in columns that must not have any."""
    return {f"null_{c}": F.count_if(ref(c).isNull()) for c in NOT_NULL}
