"""Aggregates over the transaction snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.values import exact_sum
from assaykit.operators.profiling import distinct_counts

# Figure -> column whose different values it counts.
COUNTED = {"invoices": "invoice_no", "products": "stock_code", "countries": "country"}


def kpi_summary(snapshot: DataFrame) -> DataFrame:
    """Rows, invoices, products, countries, revenue and cancellations.

    Distinct counts come from the relation of distinct values (one shuffle of merged values, no copy of the rows for each
    count); the other figures are a plain aggregate. Both meet as one row each.
    """
    plain = snapshot.agg(
        F.count(F.lit(1)).alias("total_rows"),
        exact_sum(F.col("revenue")).alias("total_revenue"),
        F.count_if("is_cancellation").alias("cancellation_rows"),
    )
    counts = distinct_counts(snapshot, list(COUNTED.values())).groupBy().agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("unique_count"))), F.lit(0)).alias(n) for n, c in COUNTED.items()])
    names = ["total_rows", *COUNTED, "total_revenue", "cancellation_rows"]
    return plain.unionByName(counts, True).agg(*[F.max(n).alias(n) for n in names])


def monthly_revenue(snapshot: DataFrame) -> DataFrame:
    month = F.date_format(F.trunc("invoice_date", "MM"), "yyyy-MM-dd")
    return snapshot.groupBy(month.alias("month")).agg(
        exact_sum(F.col("revenue")).alias("revenue")).orderBy("month")


def top_products(snapshot: DataFrame, size: int = 10) -> DataFrame:
    """Products with the highest revenue; equal revenue by code."""
    return snapshot.groupBy("stock_code").agg(
        F.max("description").alias("description"),
        exact_sum(F.col("quantity")).alias("quantity"),
        exact_sum(F.col("revenue")).alias("revenue"),
    ).orderBy(F.desc("revenue"), "stock_code").limit(size)


def product_label() -> Column:
    return F.concat("stock_code", F.lit(" — "), F.coalesce("description", F.lit("Unknown")))


def labelled_products(snapshot: DataFrame, size: int = 10) -> DataFrame:
    """Top products with a display label, lowest revenue first."""
    return top_products(snapshot, size).select(
        product_label().alias("label"), "revenue").orderBy("revenue", "label")


def country_revenue(snapshot: DataFrame, size: int = 15) -> DataFrame:
    return snapshot.filter(F.col("country").isNotNull()).groupBy("country").agg(
        exact_sum(F.col("revenue")).alias("revenue")).orderBy(F.desc("revenue"), "country").limit(size)


def cancellation_rate(snapshot: DataFrame) -> DataFrame:
    rows, cancelled = F.count(F.lit(1)), F.count_if("is_cancellation")
    return snapshot.agg(
        rows.alias("total_rows"), cancelled.alias("cancellation_rows"),
        F.when(rows > 0, cancelled / rows * 100).otherwise(0.0).alias("cancellation_rate"))
