"""Tables written between the steps of an operator.

A step that later steps read more than once is written as Parquet to the
shared folder of the cluster, so its lineage is short and no executor's loss
can take it away.
"""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import loomquery
from loomquery.sources.folders import own_folder, remove


#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application: they needn't have it installed."""
    context = spark.sparkContext
    root = pathlib.Path(loomquery.__file__).parent
    if context.applicationId in _shipped or not root.is_dir():  # in an archive, it was shipped to here
        return
    local = tempfile.mkdtemp(prefix="loomquery-")
    atexit.register(shutil.rmtree, local, True)
    with zipfile.ZipFile(f"{local}/loomquery.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"loomquery/{path.relative_to(root)}")
    context.addPyFile(f"{local}/loomquery.zip")
    _shipped.add(context.applicationId)


class Store:
    """Tables of one run of an operator, in one folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.folder = own_folder(spark, name)  # removed when the application ends: results are read from it
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:04d}-{name}"

    def cut(self, df: DataFrame, name: str, *partition_by: str, clean: bool = False) -> DataFrame:
        """Write df and return the table that was written. clean: the shuffle files of the write go with its end, not when the driver's garbage is collected."""
        path = self.path(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        before = self.spark.conf.get(CLEANUP, None)
        try:
            if clean:
                self.spark.conf.set(CLEANUP, "true")
            writer.parquet(path)
        finally:
            if clean and before is None:
                self.spark.conf.unset(CLEANUP)
            elif clean:
                self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._loomquery_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            remove(self.spark, table._loomquery_path)

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Remove the part of a table (column=value) that nothing reads any more."""
        remove(self.spark, f"{table._loomquery_path}/{part}")


#: Bytes of an Arrow batch that a function is given at once.
SLICE_BYTES = 8 << 20


def slices(batches):
    """The batches in slices of about SLICE_BYTES, without copies; afterwards, the worker's memory goes back to the system."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside other tasks of their executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def over_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function over an iterator of batches, whose batches are slices of bounded size."""

    def run(batches):
        try:
            yield from function(slices(batches))
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a plain batch function: RecordBatch -> iterable of RecordBatch."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return over_batches(df, run, schema)
