"""Aggregates whose types or results differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_(value: Column | str, scale: int = 0) -> Column:
    """Sum of integers as a decimal, which doesn't overflow at 64 bits."""
    return F.sum(F.col(value).cast(f"decimal(38,{scale})") if isinstance(value, str) else value.cast(f"decimal(38,{scale})"))


def avg_(value: Column | str) -> Column:
    """Average of integers as a decimal."""
    return F.avg((F.col(value) if isinstance(value, str) else value).cast("decimal(28,6)"))


def total(value: Column | str) -> Column:
    """Sum as a double; 0.0 without rows."""
    return F.coalesce(F.sum((F.col(value) if isinstance(value, str) else value).cast("double")), F.lit(0.0))


def string_agg(value: Column | str, separator: str = ",", distinct: bool = False) -> Column:
    """Texts joined in their own order, so that the result doesn't depend on the partitions. One group's texts meet in one place."""
    collect = F.collect_set if distinct else F.collect_list
    return F.when(F.count(value) > 0, F.array_join(F.array_sort(collect(value)), separator))


def when(condition: Column, value: Column | str = "*") -> Column:
    """What an aggregate over a window takes instead of a FILTER clause."""
    return F.when(condition, F.lit(1) if isinstance(value, str) and value == "*" else F.col(value) if isinstance(value, str) else value)
