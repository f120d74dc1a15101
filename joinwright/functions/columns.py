"""Column helpers with the semantics the join queries rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nulls_last(*names: str) -> list[Column]:
    """Ascending order with NULLs last (Spark's default puts them first)."""
    return [F.col(n).asc_nulls_last() for n in names]


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient truncated toward zero; ``/`` is fractional in Spark."""
    return F.call_function("div", a, b)


def money_sum(name: str, scale: int = 2) -> Column:
    """Sum of doubles that hold decimal amounts, independent of the order of rows."""
    return F.sum(F.col(name).cast(f"decimal(18,{scale})")).cast("double")
