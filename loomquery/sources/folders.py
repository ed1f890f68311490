"""Shared folders: where tables go that outlive a task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a folder of this machine, one an application, only without a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
    if context.applicationId not in _local:
        own = tempfile.mkdtemp(prefix="loomquery-")
        atexit.register(shutil.rmtree, own, True)
        _local[context.applicationId] = "file://" + own
    return _local[context.applicationId]


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; what is in it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target, system = _file_system(spark, path)
    system.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())
