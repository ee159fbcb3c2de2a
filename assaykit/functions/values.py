"""Column helpers: null and NaN rules, lenient numbers, percentages, exact sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
FLOAT_TYPES = ("float", "double")
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def ref(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_literal(text: str) -> str:
    """Text as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def is_number(dtype: str) -> bool:
    """True for types that carry numeric statistics; booleans count as numbers."""
    return dtype in INTEGER_TYPES or dtype in FLOAT_TYPES or dtype.startswith("decimal") or dtype == "boolean"


def same_family(actual: str, expected: str) -> bool:
    """Integers of any width match each other, so do floats; all else must be equal."""
    for family in (INTEGER_TYPES, FLOAT_TYPES):
        if actual in family and expected in family:
            return True
    return actual == expected


def holds(predicate: Column) -> Column:
    """Two-valued predicate: unknown is false, so that negating it is safe."""
    return F.coalesce(predicate, F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floats with NaN as null: the two are one missing value everywhere in this package."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({n: F.when(~F.isnan(ref(n)), ref(n)) for n in floats})


def tokens_to_null(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """String columns with the given texts as null."""
    tokens = list(tokens)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts or not tokens:
        return df
    return df.withColumns({n: F.when(~ref(n).isin(tokens), ref(n)) for n in texts})


def to_number(name: str, dtype: str) -> Column:
    """Lenient number: bad text becomes null. Text such as ``1d`` is not taken as a number."""
    column = ref(name)
    if is_number(dtype):
        return column.cast("int") if dtype == "boolean" else column
    if dtype != "string":
        return column.try_cast("double")
    return F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))


def share(count: Column, total: Column, digits: int = 2) -> Column:
    """``count`` as a percentage of ``total``, null without rows."""
    return F.when(total > 0, F.round(count / total * 100, digits))


def finite(value: Column, digits: int = 4) -> Column:
    """Rounded double; NaN and infinities become null."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.round(value, digits))


def exact_sum(value: Column) -> Column:
    """Sum in decimals, so that the order of addition cannot change the result.

    One type for all amounts; an amount of more than 24 digits before the point is an error.
    """
    return F.sum(value.cast("decimal(28,4)")).cast("double")
