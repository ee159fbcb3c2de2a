"""Profile of a table: columns, numbers, missing cells, copies, dates, business counters, flags.

Every section is a lazy DataFrame. Figures that need no distinct values come from one pass over
the rows, :func:`facts`. Distinct counts, samples, medians and top values are exact and come from
one relation, :func:`value_counts`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.config import Settings
from assaykit.functions.dates import date_shape, iso_text, parse_date
from assaykit.functions.values import finite, holds, is_number, nan_to_null, ref, share, to_number
from assaykit.operators.checks import cancelled
from assaykit.operators.measure import EXACT, REPEATS, ROWS, measure
from assaykit.session import stored

SAMPLE_SIZE = 5
TOP_COUNTRIES = 5
# Flags in report order.
FLAGS = ("HIGH_MISSING_CUSTOMER_ID", "DUPLICATE_ROWS_DETECTED", "MISSING_EXPECTED_COLUMNS", "UNEXPECTED_EXTRA_COLUMNS",
         "NO_CRITICAL_FLAGS")
NULLS_KEPT = {"ignoreNullFields": "false"}
FIXED_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}


def _prepared(df: DataFrame, order_by: str | None = None) -> tuple[DataFrame, list[str], dict[str, str]]:
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != order_by]
    return df, columns, dict(df.dtypes)


def _rows_of(spark: SparkSession, structs: Sequence[Column]) -> DataFrame:
    """A few constant rows, made by the planner and not shipped from Python."""
    return spark.range(1).select(F.inline(F.array(*structs)))


def column_list(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Column names with position and type."""
    return _rows_of(df.sparkSession, [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("dtype"))
        for i, (n, t) in enumerate((n, t) for n, t in df.dtypes if n != order_by)
    ])


# One pass over the rows --------------------------------------------------------------------------

def _number(name: str, dtypes: dict[str, str]) -> Column:
    return to_number(name, dtypes[name])


def _business_counters(columns: Sequence[str], dtypes: dict[str, str]) -> dict[str, Column]:
    """Business counters that need no distinct values, in report order."""
    out: dict[str, Column] = {}
    if "CustomerID" in columns:
        out["rows_without_customer_id"] = F.count_if(ref("CustomerID").isNull())
    if "InvoiceNo" in columns:
        out["cancellation_invoices"] = F.count_if(cancelled())
        out["cancellation_percentage"] = share(F.count_if(cancelled()), F.count(F.lit(1)))
    if "Quantity" in columns:
        quantity = _number("Quantity", dtypes)
        unexplained = holds(quantity < 0) & ~cancelled() if "InvoiceNo" in columns else F.lit(False)
        out["negative_quantity_rows"] = F.count_if(quantity < 0)
        out["zero_quantity_rows"] = F.count_if(quantity == 0)
        out["negative_on_non_cancellation"] = F.count_if(unexplained)
        out["min_quantity"] = F.min(quantity).cast("bigint")
        out["max_quantity"] = F.max(quantity).cast("bigint")
    if "UnitPrice" in columns:
        price = _number("UnitPrice", dtypes)
        out["zero_price_rows"] = F.count_if(price == 0)
        out["negative_price_rows"] = F.count_if(price < 0)
        out["min_price"] = F.round(F.min(price).cast("double"), 2)
        out["max_price"] = F.round(F.max(price).cast("double"), 2)
        out["mean_price"] = F.round(F.avg(price), 2)
    return out


def facts(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row with every figure that needs neither distinct values nor a shuffle of rows.

    The sections below select from it. Used on its own, a section makes Spark compute only the
    figures it shows.
    """
    df, columns, dtypes = _prepared(df, order_by)
    figures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        figures.append(F.count_if(ref(name).isNull()).alias(f"nulls_{i}"))
        if dtypes[name] in ("string", "binary"):
            figures.append(F.coalesce(F.sum(F.octet_length(ref(name)).cast("bigint")), F.lit(0)).alias(f"bytes_{i}"))
        else:
            figures.append((F.count(F.lit(1)) * FIXED_WIDTHS.get(dtypes[name], 8)).alias(f"bytes_{i}"))
        if is_number(dtypes[name]):
            value = _number(name, dtypes).cast("double")
            figures += [F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}"),
                        F.avg(value).alias(f"mean_{i}"), F.stddev_samp(value).alias(f"std_{i}")]
    figures += [c.alias(n) for n, c in _business_counters(columns, dtypes).items()]
    return df.agg(*figures)


def _facts(df: DataFrame, known: DataFrame | None, order_by: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    types = [(n, t) for n, t in df.dtypes if n != order_by]
    return (facts(df, order_by) if known is None else known), types


def overview(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows, columns and size of the values."""
    known, types = _facts(df, known)
    size = F.expr(" + ".join(f"bytes_{i}" for i in range(len(types))) or "0")
    return known.select(
        "rows", F.lit(len(types)).cast("bigint").alias("columns"),
        F.lit(", ".join(n for n, _ in types)).alias("column_names"),
        size.alias("data_bytes"), F.round(size / 1024 / 1024, 2).alias("data_mb"))


def structure(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Position, type, rows and bytes of each column."""
    known, types = _facts(df, known)
    cells = [c for i, (n, t) in enumerate(types) for c in (
        F.lit(i).cast("bigint"), F.lit(n), F.lit(t), F.col(f"bytes_{i}"))]
    return known.select("rows", F.stack(F.lit(len(types)), *cells).alias("position", "name", "dtype", "data_bytes"))


# Distinct values ---------------------------------------------------------------------------------

def _slots(name: str, dtype: str) -> list[Column]:
    """A value as (text, whole, real): exact for each type, without turning numbers into text."""
    value = ref(name)
    text = whole = real = F.lit(None)
    if dtype == "boolean" or dtype in ("tinyint", "smallint", "int", "bigint"):
        whole = value
    elif dtype in ("float", "double"):
        real = value + F.lit(0.0)  # -0.0 and 0.0 are one value
    elif dtype.startswith("decimal"):
        text, real = value, value
    else:
        text = value
    return [F.lit(name), text.cast("string"), whole.cast("bigint"), real.cast("double")]


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None) -> DataFrame:
    """Each distinct value of each column with its number of rows; null is one of the values.

    One scan and one shuffle for all columns. Equal values are merged before the shuffle, so a
    value that fills a third of the table costs one record per task. ``order_by`` adds the lowest
    position a value was seen at.
    """
    df, all_columns, dtypes = _prepared(df, order_by)
    columns = list(columns or all_columns)
    cells = [c for n in columns for c in _slots(n, dtypes[n])]
    position = [ref(order_by).alias("__position")] if order_by else []
    long = df.select(
        *position, F.stack(F.lit(len(columns)), *cells).alias("column", "text", "whole", "real"))
    first = [F.min("__position").alias("first_seen")] if order_by else []
    return long.groupBy("column", "text", "whole", "real").agg(F.count(F.lit(1)).alias("copies"), *first)


def _present() -> Column:
    return F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull()


def _as_text(dtypes: dict[str, str]) -> Column:
    flags = [n for n, t in dtypes.items() if t == "boolean"]
    whole = F.when(F.col("column").isin(flags), F.when(F.col("whole") == 1, "True").otherwise("False")) \
        if flags else F.lit(None).cast("string")
    return F.coalesce(F.col("text"), whole, F.col("whole").cast("string"), F.col("real").cast("string"))


def samples(df: DataFrame, order_by: str | None = None, size: int = SAMPLE_SIZE,
            values: DataFrame | None = None) -> DataFrame:
    """First distinct values per column: by position if there is one, else the smallest values.

    Spark keeps only ``size`` rows per column and task before it shuffles for the ranking.
    """
    values = value_counts(df, order_by=order_by) if values is None else values
    order = [F.col("first_seen")] if order_by else [F.col("whole"), F.col("real"), F.col("text")]
    ranked = values.filter(_present()).withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.filter(F.col("rank") <= size).select(
        "column", F.col("rank").cast("bigint").alias("rank"), _as_text(dict(df.dtypes)).alias("value"))


def columns_profile(df: DataFrame, order_by: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """Type, nulls, distinct values and sample values of each column."""
    values = value_counts(df, order_by=order_by) if values is None else values
    per_column = values.groupBy("column").agg(
        F.sum("copies").alias("rows"),
        F.coalesce(F.sum(F.when(~_present(), F.col("copies"))), F.lit(0)).alias("null_count"),
        F.count_if(_present()).alias("unique_count"),
    )
    shown = samples(df, order_by, values=values).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("__samples"))
    return (
        column_list(df, order_by)
        .join(per_column, "column", "left")
        .join(shown, "column", "left")
        .select(
            "position", F.col("column").alias("name"), "dtype",
            F.coalesce("null_count", F.lit(0)).cast("bigint").alias("null_count"),
            share(F.col("null_count"), F.col("rows")).alias("null_percentage"),
            F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
            F.coalesce(F.transform("__samples", lambda s: s["value"]), F.array().cast("array<string>"))
            .alias("sample_values"),
        )
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], values: DataFrame | None = None) -> DataFrame:
    """Number of different values per column, nulls not counted."""
    values = value_counts(df, columns) if values is None else values.filter(F.col("column").isin(list(columns)))
    return values.groupBy("column").agg(F.count_if(_present()).alias("unique_count"))


# Numbers -----------------------------------------------------------------------------------------

def _located(counted: DataFrame, order: str) -> DataFrame:
    """Of rows with a count ``n``, the one per target at which the running count reaches the rank."""
    upto = f"below + sum(n) OVER (PARTITION BY column, target ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return counted.selectExpr("*", f"{upto} AS upto").filter("upto - n < rank AND rank <= upto")


def value_ranges(values: DataFrame) -> DataFrame:
    """Distinct values (column, v, n) dealt out by order: ``part`` numbers consecutive ranges of about equal size.

    Bounds are quantiles of the values themselves, so neither a long tail nor an outlier fills a range; a value occurs
    once however often its rows do, so no value is too frequent for one either.
    """
    return values.repartitionByRange("column", "v").withColumn("part", F.spark_partition_id())


def medians(df: DataFrame, values: DataFrame | None = None,
            stage: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Exact median per numeric column; a task puts at most one range of the distinct values in order.

    Ranges are written once by ``stage``. Running counts over the ranges (as many rows as there are ranges) tell which of
    them holds a middle rank, and only the values of those are read again. Infinities are values like any other.
    """
    numeric = [n for n, t in df.dtypes if is_number(t)]
    values = value_counts(df, numeric) if values is None else values.filter(F.col("column").isin(numeric))
    values = values.selectExpr(
        "column", "coalesce(real, cast(whole as double)) AS v", "copies AS n").filter("v IS NOT NULL")
    ranges = stage(value_ranges(values), "value-ranges")
    counted = ranges.groupBy("column", "part").agg(F.sum("n").alias("n"))
    middle = "array_distinct(array((total + 1) div 2, total div 2 + 1))"
    targets = counted.selectExpr("*", "sum(n) OVER (PARTITION BY column) AS total").selectExpr(
        "column", "part", "n", f"explode({middle}) AS target").withColumn("rank", F.col("target"))
    hit = _located(targets.withColumn("below", F.lit(0)), "part").select(
        "column", "part", "target", "rank", (F.col("upto") - F.col("n")).alias("below")).collect()  # two rows a column
    found = ranges.sparkSession.createDataFrame(
        hit, "column string, part int, target bigint, rank bigint, below bigint")
    last = ranges.filter(F.col("part").isin(sorted({r["part"] for r in hit}))).join(F.broadcast(found), ["column", "part"])
    return _located(last, "v").groupBy("column").agg(F.avg("v").alias("median"))


def moments(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Minimum, maximum, mean and sample deviation per numeric column."""
    known, types = _facts(df, known)
    numeric = [(i, n) for i, (n, t) in enumerate(types) if is_number(t)]
    cells = [c for i, n in numeric for c in (F.lit(n), *[F.col(f"{k}_{i}") for k in ("min", "max", "mean", "std")])]
    return known.select(F.stack(F.lit(len(numeric)), *cells).alias("column", "min", "max", "mean", "std"))


def numeric_profile(df: DataFrame, known: DataFrame | None = None, values: DataFrame | None = None,
                    stage: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Minimum, maximum, mean, deviation and median of each numeric column, 4 decimals."""
    df = nan_to_null(df)
    if not any(is_number(t) for _, t in df.dtypes):
        return df.sparkSession.range(0).select(
            F.lit("").alias("name"), *[F.lit(0.0).alias(k) for k in ("min", "max", "mean", "std", "median")])
    return moments(df, known).join(medians(df, values, stage), "column", "left").select(
        F.col("column").alias("name"), *[finite(F.col(k)).alias(k) for k in ("min", "max", "mean", "std", "median")])


# Missing cells and copies ------------------------------------------------------------------------

def null_counts(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows and nulls per column."""
    known, types = _facts(df, known)
    cells = [c for i, (n, _) in enumerate(types) for c in (F.lit(n), F.col(f"nulls_{i}"))]
    return known.select("rows", F.stack(F.lit(len(types)), *cells).alias("name", "missing_count"))


def missing_per_column(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Columns that have missing values."""
    return null_counts(df, known).filter("missing_count > 0").select(
        "name", "missing_count", share(F.col("missing_count"), F.col("rows")).alias("missing_percentage"))


def missing_summary(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Missing cells of the whole table."""
    return null_counts(df, known).agg(
        F.sum("missing_count").alias("total_missing_cells"),
        share(F.sum("missing_count"), F.sum("rows")).alias("total_missing_percentage"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"))


def copies(df: DataFrame, row_key: str = EXACT, order_by: str | None = None,
           stage: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """One row: rows, repeated rows and rows without a customer, for the sections on copies and flags."""
    df, columns, _ = _prepared(df, order_by)
    predicates = {"no_customer": ref("CustomerID").isNull()} if "CustomerID" in columns else {}
    return measure(df, columns, predicates, row_key=row_key, stage=stage)


def duplicates_profile(df: DataFrame, row_key: str = EXACT, order_by: str | None = None,
                       counted: DataFrame | None = None) -> DataFrame:
    """Rows that repeat an earlier row, all columns compared."""
    counted = copies(df, row_key, order_by) if counted is None else counted
    return counted.select(
        F.col(REPEATS).alias("duplicate_row_count"),
        share(F.col(REPEATS), F.col(ROWS)).alias("duplicate_percentage"),
        (F.col(ROWS) - F.col(REPEATS)).alias("unique_rows"))


# Dates -------------------------------------------------------------------------------------------

def daily_volume(df: DataFrame, column: str = "InvoiceDate", settings: Settings | None = None,
                 order_by: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """Rows, first and last moment per layout and day; rows without a date have neither.

    Of dates in text each different one is read once if ``values`` (see :func:`value_counts`) is given.
    """
    settings = settings or Settings()
    dtype = dict(df.dtypes)[column]
    if values is not None and dtype == "string":
        df = values.filter(F.col("column") == column)
        text, number, position = F.col("text"), F.col("copies"), "first_seen"
    else:
        text, number, position = ref(column), F.lit(1).cast("bigint"), order_by
    parsed = df.select(
        parse_date(text, dtype, settings.extra_date_formats).alias("ts"), date_shape(text, dtype).alias("shape"), number.alias("copies"),
        *([ref(position).alias("__position")] if order_by else []))
    first = [F.min("__position").alias("first_seen")] if order_by else []
    return parsed.groupBy(
        F.when(F.col("ts").isNotNull(), F.col("shape")).alias("shape"), F.to_date("ts").alias("day")
    ).agg(F.sum("copies").alias("rows"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), *first)


def dates_profile(df: DataFrame, column: str = "InvoiceDate", settings: Settings | None = None,
                  order_by: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """Range, span and daily volume of the dates in one layout.

    The layout is that of the first date if rows have positions, else the most frequent one. Values
    in any other layout count as invalid, and so do nulls.
    """
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit(f"{column} column not found").alias("error"))
    days = daily_volume(df, column, settings, order_by, values)
    first = [F.expr("min(first_seen) AS first_seen")] if order_by else []
    shapes = days.groupBy("shape").agg(
        F.expr("sum(rows) AS rows"), F.expr("min(earliest) AS earliest"), F.expr("max(latest) AS latest"),
        F.expr("min(rows) AS low"), F.expr("max(rows) AS high"), F.expr("avg(rows) AS mean"),
        F.expr("count(1) AS days"), *first)
    packed = "struct(rows, earliest, latest, low, high, mean, days)"
    if order_by:
        chosen = f"min_by({packed}, if(shape IS NOT NULL, first_seen, null)) AS d"
    else:
        chosen = f"max_by({packed}, if(shape IS NOT NULL, struct(rows, shape), null)) AS d"
    return shapes.agg(F.expr("coalesce(sum(rows), 0) AS total"), F.expr(chosen)).select(
        iso_text(F.col("d.earliest")).alias("earliest_date"),
        iso_text(F.col("d.latest")).alias("latest_date"),
        *[F.expr(e) for e in (
            "timestampdiff(DAY, d.earliest, d.latest) AS date_span_days",
            "total - coalesce(d.rows, 0) AS invalid_dates",
            "d.low AS min_transactions_per_day",
            "d.high AS max_transactions_per_day",
            "round(d.mean, 1) AS mean_transactions_per_day",
            "d.days AS total_trading_days",
            "if(d IS NULL, 'No valid dates could be parsed', null) AS error",
        )],
    )


# Business counters -------------------------------------------------------------------------------

# Distinct counter -> column, each before the counter that follows it in the report.
DISTINCT_COUNTERS = {
    "unique_customers": "CustomerID",
    "unique_products": "StockCode",
    "unique_countries": "Country",
    "unique_invoices": "InvoiceNo",
}
BUSINESS_ORDER = (
    "unique_customers", "rows_without_customer_id", "unique_products", "unique_countries", "unique_invoices",
    "cancellation_invoices", "cancellation_percentage", "negative_quantity_rows", "zero_quantity_rows",
    "negative_on_non_cancellation", "min_quantity", "max_quantity", "zero_price_rows", "negative_price_rows",
    "min_price", "max_price", "mean_price",
)


def business_profile(df: DataFrame, known: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Customers, products, countries, invoices, quantities and prices; absent columns are left out.

    Distinct counts come from the distinct values, the other figures from the one pass over the
    rows; both meet as metric rows, so no join is needed.
    """
    known, types = _facts(df, known)
    columns = [n for n, _ in types]
    plain = list(_business_counters(columns, dict(types)))
    counted = {m: c for m, c in DISTINCT_COUNTERS.items() if c in columns}
    whole = {n for n, t in known.dtypes if t == "bigint"}
    cells = ", ".join(
        f"'{n}', {n if n in whole else 'cast(null as bigint)'}, cast({n} as double)" for n in [*plain, "rows"])
    metrics = known.selectExpr(f"stack({len(plain) + 1}, {cells}) AS (metric, whole, real)")
    if counted:
        if values is None:
            values = value_counts(df, list(counted.values()))
        names = ", ".join(f"'{c}', '{m}'" for m, c in counted.items())
        per_column = distinct_counts(df, list(counted.values()), values)
        metrics = metrics.unionByName(per_column.selectExpr(
            f"map({names})[column] AS metric", "unique_count AS whole", "cast(unique_count as double) AS real"))
    return metrics.agg(*[
        F.expr(f"max(if(metric = '{n}', {'whole' if n in whole or n in counted else 'real'}, null)) AS {n}")
        for n in BUSINESS_ORDER if n in plain or n in counted
    ])


def top_countries(df: DataFrame, size: int = TOP_COUNTRIES, values: DataFrame | None = None) -> DataFrame:
    """Countries with the most rows; equal counts by name."""
    values = value_counts(df, ["Country"]) if values is None else values.filter(F.col("column") == "Country")
    return values.filter(F.col("text").isNotNull()).select(
        F.col("text").alias("country"), F.col("copies").alias("rows")).orderBy(F.desc("rows"), "country").limit(size)


# Flags -------------------------------------------------------------------------------------------

def flags(df: DataFrame, settings: Settings | None = None, row_key: str = EXACT,
          order_by: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Structural observations, or one row that says there are none."""
    settings = settings or Settings()
    columns = [c for c in df.columns if c != order_by]
    missing = [c for c in settings.columns if c not in columns]
    extra = [c for c in columns if c not in settings.columns]
    counted = copies(df, row_key, order_by) if counted is None else counted

    def flag(name: str, severity: str, message: Column | str, note: str | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("flag"), F.lit(severity).alias("severity"),
            (message if isinstance(message, Column) else F.lit(message)).alias("message"),
            F.lit(note).cast("string").alias("note"))

    found = []
    if "CustomerID" in columns:
        pct = F.when(F.col(ROWS) > 0, F.col("no_customer") / F.col(ROWS) * 100)
        found.append(F.when(pct > 20, flag(
            "HIGH_MISSING_CUSTOMER_ID", "WARNING",
            F.concat(F.format_string("%.1f", pct), F.lit("% of rows have no CustomerID.")),
            "This is expected for guest purchases in retail data.")))
    found.append(F.when(F.col(REPEATS) > 0, flag(
        "DUPLICATE_ROWS_DETECTED", "WARNING",
        F.concat(F.format_number(F.col(REPEATS), 0), F.lit(" fully duplicate rows found.")))))
    if missing:
        found.append(flag("MISSING_EXPECTED_COLUMNS", "CRITICAL", f"Expected columns not found: {missing}"))
    if extra:
        found.append(flag("UNEXPECTED_EXTRA_COLUMNS", "INFO", f"Extra columns present: {extra}"))
    none = F.array(flag("NO_CRITICAL_FLAGS", "OK", "No critical structural issues detected."))
    listed = counted.select(F.array_compact(F.array(*found)).alias("found"))
    return listed.select(F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(none)))


# Report ------------------------------------------------------------------------------------------

def profile(df: DataFrame, settings: Settings | None = None, row_key: str = EXACT, order_by: str | None = None,
            stage: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All sections by name. ``order_by`` names a position column (see ``load_csv(keep_order=True)``).

    ``stage(rows, name)`` may store the two relations that several sections share, so that the table
    is read once for each instead of once per section.
    """
    data = df.drop(order_by) if order_by else df
    known, values, counted = facts(data), value_counts(df, order_by=order_by), copies(data, row_key, stage=stage or stored)
    if stage:
        known, values, counted = stage(known, "facts"), stage(values, "values"), stage(counted, "copies")
    sections = {
        "overview": overview(data, known),
        "columns": columns_profile(df, order_by, values),
        "numeric": numeric_profile(data, known, values, stage or stored),
        "missing_values": missing_summary(data, known),
        "missing_per_column": missing_per_column(data, known),
        "duplicates": duplicates_profile(data, row_key, counted=counted),
        "date_analysis": dates_profile(df, settings=settings, order_by=order_by, values=values),
        "business_analysis": business_profile(data, known, values),
        "quality_flags": flags(data, settings, row_key, counted=counted),
    }
    if "Country" in data.columns:
        sections["top_countries"] = top_countries(data, values=values)
    return sections


def _report_order(section: str, columns: Sequence[str]) -> Column:
    """Where a record of a section stands in the report."""
    if section in ("numeric", "missing_per_column"):
        return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("name"))
    if section == "columns":
        return F.col("position")
    if section == "quality_flags":
        return F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("flag"))
    return F.struct(-F.col("rows"), "country") if section == "top_countries" else F.lit(0)


def profile_document(sections: dict[str, DataFrame], dataset_name: str) -> DataFrame:
    """One row with the whole profile as a JSON text.

    Every section is a list of records in report order: columns as in the table, countries by rows, flags by kind. A figure
    that does not exist is written as null.
    """
    spark = next(iter(sections.values())).sparkSession
    columns = [r["name"] for r in sections["columns"].orderBy("position").select("name").collect()] if "columns" in sections else []
    rows = None
    for i, (name, section) in enumerate(sections.items()):
        body = section.select(F.struct(
            _report_order(name, columns).alias("place"),
            F.to_json(F.struct(*[ref(c) for c in section.columns]), NULLS_KEPT).alias("body")).alias("record"))
        listed = body.agg(F.array_sort(F.collect_list("record")).alias("records")).select(
            F.lit(i).alias("i"), F.concat(
                F.lit(f'"{name}":['), F.array_join(F.transform("records", lambda r: r["body"]), ","), F.lit("]")).alias("part"))
        rows = listed if rows is None else rows.unionByName(listed)
    head = spark.range(1).select(F.lit(-1).alias("i"), F.concat(
        F.lit('"dataset":'), F.to_json(F.struct(
            F.lit(dataset_name).alias("name"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("profiled_at"),
        ))).alias("part"))
    parts = rows.unionByName(head).agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts"))
    return parts.select(F.concat(
        F.lit("{"), F.array_join(F.transform("parts", lambda p: p["part"]), ","), F.lit("}")).alias("value"))
