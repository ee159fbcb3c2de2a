"""Readers for CSV, Parquet and workbooks, and structural information about a table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from time import perf_counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.config import Settings
from assaykit.functions.values import INTEGER_TEXT, NUMBER_TEXT, nan_to_null, ref, tokens_to_null
from assaykit.operators.profiling import overview
from assaykit.sources import workbook

POSITION = "__position"
ENCODINGS = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf8": "UTF-8"}
# Texts that a column of truth values may hold.
TRUTH_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"
COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


@dataclass
class Extraction:
    """A table that was read, with the figures of the read. ``rows`` is None until a job counts them."""

    df: DataFrame
    source: str
    rows: int | None
    columns: int
    seconds: float


def _opened(path: str, read) -> DataFrame:
    """``read()`` with Spark's path errors turned into the errors a caller expects."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Dataset not found at: {path}") from error
        raise ValueError(f"Failed to read {path}: {error}") from error


# Types of text columns ---------------------------------------------------------------------------

def _kind_counts(texts: list[str]) -> list[Column]:
    """Per text column: values, whole numbers, numbers and truth values."""
    out = []
    for i, name in enumerate(texts):
        c = ref(name)
        number = c.rlike(NUMBER_TEXT) | c.rlike(INFINITE_TEXT)
        out += [
            F.count(c).alias(f"values_{i}"),
            F.count_if(c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"whole_{i}"),
            F.count_if(number).alias(f"number_{i}"),
            F.count_if(c.isin(*TRUTH_TEXTS)).alias(f"truth_{i}"),
        ]
    return out


def _kind(rows: int, values: int, whole: int, number: int, truth: int) -> str:
    """Whole numbers need a complete column; one with gaps holds doubles, as does an empty one."""
    if whole == values == rows:
        return "bigint"
    if number == values:
        return "double"
    if truth == values == rows:
        return "boolean"
    return "string"


def typed_by_content(df: DataFrame, texts: list[str], extra: list[Column] | None = None):
    """Text columns with the type their values allow; also returns the row of counts. One pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *_kind_counts(texts), *(extra or [])).first()
    types = {
        n: _kind(counts["rows"], *[counts[f"{k}_{i}"] for k in ("values", "whole", "number", "truth")])
        for i, n in enumerate(texts)
    }
    casts = {n: F.trim(ref(n)).try_cast(t) for n, t in types.items() if t != "string"}
    return (df.withColumns(casts) if casts else df), counts


# CSV ---------------------------------------------------------------------------------------------

def extract_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "latin-1",
    schema: T.StructType | None = None,
    keep_order: bool = False,
    multi_line: bool = False,
    settings: Settings | None = None,
) -> Extraction:
    """Read a CSV file, folder or pattern.

    Without ``schema`` the column types follow from the values, which takes one pass over the text
    and lets the schema check see drift. With ``schema`` there is no such pass, and a value that does
    not fit makes the job fail. ``keep_order`` adds a number to each row that grows along a file;
    with several files, their pieces follow each other in the order in which Spark reads them.
    ``multi_line`` allows line breaks inside quotes, at the price of one task per file; without it they
    are an error. So are files whose headers differ.
    """
    settings = settings or Settings()
    started = perf_counter()
    options = {
        "header": "true", "encoding": ENCODINGS.get(encoding.lower(), encoding), "quote": '"', "escape": '"',
        "multiLine": str(multi_line).lower(),
    }
    position = F.monotonically_increasing_id().alias(POSITION)
    added = [position] if keep_order else []

    if schema is not None:
        df = _opened(path, lambda: spark.read.options(**options, mode="FAILFAST", enforceSchema="false")
                     .schema(schema).csv(path))
        df = nan_to_null(tokens_to_null(df.select("*", *added), settings.null_tokens))
        if df.isEmpty():
            raise ValueError(f"The dataset at {path} is empty.")
        return Extraction(df, path, None, len(schema), round(perf_counter() - started, 4))

    header = _opened(path, lambda: spark.read.options(**options).csv(path))
    names = header.columns
    if not names:
        raise ValueError(f"The dataset at {path} is empty.")
    broken = "__broken"
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
    # Spark compares the header of each file with the names; columns without a name get one from Spark
    named = len({n.lower() for n in names}) == len(names) and not any(re.fullmatch(r".*_c\d+|", n) for n in names)
    raw = (spark.read.options(**options, columnNameOfCorruptRecord=broken, enforceSchema=str(not named).lower())
           .schema(raw_schema).csv(path))
    raw = tokens_to_null(raw.select("*", *added), settings.null_tokens)
    too_long = F.count_if(F.regexp_count(broken, F.lit(COMMA_OUTSIDE_QUOTES)) >= len(names)).alias("too_long")
    open_quotes = F.count_if(F.regexp_count(broken, F.lit('"')) % 2 == 1).alias("open_quotes")
    try:
        typed, counts = typed_by_content(raw, names, [too_long, open_quotes])
    except Exception as error:
        raise ValueError(f"Failed to read CSV file: {error}") from error
    if counts["open_quotes"]:
        raise ValueError(f"{path}: quotes stay open at the end of {counts['open_quotes']} line(s). Cells with line breaks need "
                         "multi_line=True.")
    if counts["too_long"]:
        raise ValueError(f"Failed to read CSV file: {counts['too_long']} line(s) with more fields than the header.")
    if counts["rows"] == 0:
        raise ValueError(f"The dataset at {path} is empty.")
    df = nan_to_null(typed.drop(broken))
    return Extraction(df, path, counts["rows"], len(names), round(perf_counter() - started, 4))


def load_csv(spark: SparkSession, path: str | None = None, encoding: str = "latin-1", **options) -> DataFrame:
    """The table of :func:`extract_csv`; the path defaults to the configured raw data."""
    return extract_csv(spark, str(path or Settings.from_env().raw_data_path), encoding, **options).df


def load_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read Parquet with NaN as null."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(_opened(path, lambda: reader.parquet(path)))


# Workbooks ---------------------------------------------------------------------------------------

def load_excel(spark: SparkSession, path: str, sheet_name: str = "Online Retail",
               settings: Settings | None = None) -> DataFrame:
    """Read one sheet of every ``.xlsx`` workbook of a file, folder or pattern.

    One workbook is one task; the file format itself bounds a sheet to 1,048,576 rows. All
    workbooks must have the same header.
    """
    settings = settings or Settings()
    files = _opened(path, lambda: spark.read.format("binaryFile").load(path).select("path", "content"))
    try:
        headers = files.mapInPandas(workbook.headers(sheet_name), "header array<string>").distinct().take(2)
        if len(headers) != 1:
            raise ValueError("no workbook found" if not headers else "the workbooks have different headers")
        names = headers[0]["header"]
        cells = files.mapInPandas(workbook.rows(sheet_name, len(names)), workbook.ROW_SCHEMA)
        numbers = F.count
        kinds = cells.agg(F.count(F.lit(1)).alias("rows"), *[
            numbers(F.when(F.col("kinds")[i] == k, 1)).alias(f"{k}_{i}")
            for i in range(len(names)) for k in workbook.KINDS
        ]).first()
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"Failed to read Excel file: {error}") from error

    def column(i: int) -> Column:
        rows = kinds["rows"]
        count = {k: kinds[f"{k}_{i}"] for k in workbook.KINDS}
        filled = sum(count.values())
        value = F.col("texts")[i]
        if count["whole"] == filled == rows:
            return value.try_cast("bigint")
        if count["whole"] + count["real"] == filled:
            return value.try_cast("double")
        if count["date"] == filled:
            return value.try_cast("timestamp_ntz")
        if count["truth"] == filled == rows:
            return value.try_cast("boolean")
        return value

    return tokens_to_null(cells.select(*[column(i).alias(n) for i, n in enumerate(names)]), settings.null_tokens)


# Structure ---------------------------------------------------------------------------------------

def dataset_info(df: DataFrame) -> dict:
    """Rows, columns, types and megabytes of values; one pass."""
    row = overview(df).first()
    return {
        "rows": row["rows"],
        "columns": len(df.columns),
        "column_names": df.columns,
        "dtypes": dict(df.dtypes),
        "data_mb": row["data_mb"],
    }
