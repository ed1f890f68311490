"""Joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.sources.tables import replicated


def inner(left: DataFrame, right: DataFrame, on: Column, replicate: bool = False) -> DataFrame:
    """Rows of both sides that a condition holds for. replicate: send the right side to every executor if it is small enough."""
    return left.join(replicated(right) if replicate else right, on, "inner")


def left_outer(left: DataFrame, right: DataFrame, on: Column, replicate: bool = False) -> DataFrame:
    return left.join(replicated(right) if replicate else right, on, "left")


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """EXISTS."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame) -> DataFrame:
    """NOT IN: nothing if the right side holds a NULL; a NULL on the left stays only if the right side is empty.

    The NULL of the right side is found once and kept as a scalar, so that the
    join below it is an ordinary anti join, by hash or sort.
    """
    name = right.columns[0]
    right = right.select(F.col(name).alias("__value"))
    facts = right.agg(F.count("*").alias("__rows"), F.count(F.when(F.col("__value").isNull(), 1)).alias("__nulls"))
    kept = left.join(right.filter("__value IS NOT NULL"), F.col(column) == F.col("__value"), "left_anti")
    return kept.join(F.broadcast(facts)).filter((F.col("__rows") == 0) | (F.col("__nulls") == 0) & F.col(column).isNotNull()).drop("__rows", "__nulls")


def rows_equal(left: list[Column], right: list[Column]) -> Column:
    """(a, b) = (c, d), column by column, so that scans can be asked for each."""
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(left, right, strict=True)])


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def union(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different rows of the left that the right doesn't hold; NULLs are equal."""
    return left.subtract(right)
