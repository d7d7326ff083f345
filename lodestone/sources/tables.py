"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scope = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    getattr(_scope, "paths", []).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Folders that this thread asks for inside are removed at the end: for work that leaves its results elsewhere."""
    outer, _scope.paths = getattr(_scope, "paths", []), []
    try:
        yield
    finally:
        for path in _scope.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scope.paths = outer


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that later stages read, however often, instead of computing it again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like written(), dealt by keys for good: joins and sums by these find all rows of a key in one task, without a shuffle."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    buckets, called = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(called)
    atexit.register(_forget, spark, called)
    return spark.table(called)


def _forget(spark: SparkSession, called: str) -> None:
    """The catalogue loses the table; its folder goes with the driver."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {called}")
