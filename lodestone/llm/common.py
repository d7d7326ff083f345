"""What several operators share: the shared folder, written tables, hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Stands for a null identifier inside operators; it sorts before every other. As an identifier of its own it counts as null.
NULL_ID = -(2**63)

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder, since
    there all processes are on one machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage,
    and a lost executor costs no more than the stage that it was running."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() early."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_frame(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    drop_path(df.sparkSession, df.written_at)


def give_back() -> None:
    """Return to the system what a task's objects and arrays held; its worker goes on, and other workers of the executor need it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """run, a function of batches, whose worker gives back its memory when the task ends, and before it what other tasks left."""

    def tidied(batches):
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def wider(df: DataFrame, *fields: tuple) -> StructType:
    """The schema of df with more fields (name, type); add() would change the frame's own."""
    return StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields)])


def whole_text(name: str = "text"):
    """The text column as operators see it: null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int):
    """crc32 of the identifier as text, modulo n."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(n)


C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit values."""
    t = a * C1
    t += b
    t ^= t >> np.uint64(31)
    t *= C2
    t ^= t >> np.uint64(29)
    return t


def scramble(a: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of 64-bit values, one for each salt."""
    t = (a ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))) * C2
    t ^= t >> np.uint64(32)
    t *= C1
    t ^= t >> np.uint64(29)
    return t
