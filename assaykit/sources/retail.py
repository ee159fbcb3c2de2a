"""Retail transactions derived from the supplied order tables, clean and with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.dates import iso_text


#: Lines that one task joins and, in ``measure``, holds as different rows: some 300 MB of its memory at most.
LINES_A_TASK = 250_000
#: With fewer tasks than this, Spark's own are small enough.
LEAST_TASKS = 24
#: Parts up to which Spark's own way of joining them is left alone; it broadcasts a few millions at most.
PARTS_LEFT = 2_000_000
#: The same for customers and their orders; dealing these costs no shuffle that Spark would not make.
CUSTOMERS_LEFT = 500_000
# The columns that the retail view reads.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string,"
                " l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tasks_for(lines: DataFrame) -> int | None:
    """In how many partitions the lines are dealt; None leaves the number to Spark.

    Left to Spark, the tasks of a large table get 64 MB of compressed shuffle data, or more if the session has few shuffle
    partitions, which take more than a gigabyte to sort and group. Counting the lines reads only the footers of their files.
    """
    tasks = lines.count() // LINES_A_TASK
    return tasks if tasks >= LEAST_TASKS else None


def dealt(tasks: int | None, *sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each side in ``tasks`` partitions by its key; with None as it is."""
    return [rows if tasks is None else rows.repartition(tasks, key) for rows, key in sides]


def retail(spark: SparkSession, folder: str, faulty: bool = False, batch: bool = False, grouped: bool = False) -> DataFrame:
    """The eight source columns; ``batch`` adds ``run_id``, the number of the shipping month.

    The small sides are joined first, so that the big table is shuffled as few times as possible;
    broadcasting is left to Spark, which checks the sizes. Repeated rows come from one generator
    per row instead of a second read of the table.

    ``grouped`` is for those who group whole rows: the rows of a large table come dealt by invoice, which holds all copies of its
    rows, so that the grouping needs no shuffle of its own and its tasks hold as few lines as those of the join.
    """
    nation, customer, orders, part, lines = (
        table(spark, folder, n) for n in ("nation", "customer", "orders", "part", "lineitem"))
    tasks = tasks_for(lines)
    customers = customer.join(nation, F.expr("c_nationkey = n_nationkey"))
    orders, customers = dealt(tasks if tasks and customer.count() > CUSTOMERS_LEFT else None,
                              (orders, "o_custkey"), (customers, "c_custkey"))
    buyers = orders.join(customers, F.expr("o_custkey = c_custkey"))
    by_order, buyers = dealt(tasks, (lines, "l_orderkey"), (buyers, "o_orderkey"))
    joined = by_order.join(buyers, F.expr("l_orderkey = o_orderkey"))
    joined, part = dealt(tasks if tasks and part.count() > PARTS_LEFT else None, (joined, "l_partkey"), (part, "p_partkey"))
    joined = joined.join(part, F.expr("l_partkey = p_partkey"))

    order, returned = F.col("l_orderkey"), F.col("l_returnflag") == "R"
    adjusted = ~returned & (order % 50 == 7)
    quantity = F.when(returned | (order % 50 == 7), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.when(adjusted, 0.0).otherwise(F.col("p_retailprice"))
    date = iso_text(F.col("l_shipdate"))
    if faulty:
        quantity = F.when(order % 499 == 1, 0.0).otherwise(quantity)
        date = F.when(order % 499 == 2, "not-a-date").otherwise(date)
        price = F.when(order % 499 == 3, -F.col("p_retailprice")).otherwise(price)

    month = (F.year("l_shipdate") - 1970) * 12 + F.month("l_shipdate")
    copies = F.explode(F.sequence(F.lit(1), F.when(order % 101 == 3, 2).otherwise(1)))
    rows = joined.select(
        F.concat(F.when(returned, "C").otherwise(""), order.cast("string")).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("l_partkey") % 97 != 0, F.col("p_name")).alias("Description"),
        quantity.cast("bigint").alias("Quantity"),
        date.alias("InvoiceDate"),
        price.alias("UnitPrice"),
        F.when((F.col("o_custkey") % 4 != 0) & ~adjusted, F.col("o_custkey")).cast("double").alias("CustomerID"),
        F.col("n_name").alias("Country"),
        *([month.cast("bigint").alias("run_id")] if batch else []),
        copies.alias("__copy"),
    )
    return dealt(tasks if grouped else None, (rows.drop("__copy"), "InvoiceNo"))[0]
