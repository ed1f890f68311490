"""Tables of a session: a DataFrame with the declared key and placing."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the test data.
CORPUS = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BUCKETS = 3000


@dataclass
class Table:
    """A version of a table. kinds: declared type names by column; unique: column lists of unique indexes."""

    df: DataFrame
    key: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    required: set[str] = field(default_factory=set)
    placed: list[str] | None = None  # None: replicated everywhere
    unique: dict[str, list[str]] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)
    bucketed: DataFrame | None = None  # the rows with bucket_id, where they are written and placed

    def with_rows(self, df: DataFrame, bucketed: DataFrame | None = None) -> Table:
        return replace(self, df=df, bucketed=bucketed)


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name; all of CORPUS if none is named."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names or CORPUS}


def bucket_id(*keys: str | Column, buckets: int = BUCKETS) -> Column:
    """The bucket, 1 to buckets, that a row's key falls into. The numbers are Spark's own; equal keys share one."""
    return (F.pmod(F.xxhash64(*keys), F.lit(buckets)) + 1).cast("long")


def replicated(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A dimension that goes to every executor, if the plan's own estimate of its size is within the limit; else as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def written(table: Table, spark: SparkSession, rows: DataFrame, path: str) -> Table:
    """The table with the rows, written and read again.

    Rows of a placed table are written in the order of their buckets, each
    file with a range of its own, so that a condition on bucket_id passes by
    the files and parts of files whose bounds exclude it.
    """
    schema = rows.schema
    if not table.placed:
        rows.write.parquet(path)
        return table.with_rows(spark.read.schema(schema).parquet(path))
    rows = rows.withColumn("bucket_id", bucket_id(*table.placed))
    rows.repartitionByRange("bucket_id").sortWithinPartitions("bucket_id").write.parquet(path)
    return table.with_rows(spark.read.schema(schema).parquet(path), spark.read.schema(rows.schema).parquet(path))
