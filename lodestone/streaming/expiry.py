"""Sliding expiry as a stream: each touch of a workspace moves its expiry, the watermark closes it.

A workspace is a session window of its user's touches. Touches may come in any
order up to the watermark's delay: a touch joins what lies less than the
retention away, and so may join two workspaces into one; the result does not
depend on the order. A touch that is played again (the same user, identifier and
time) counts once: its identifier is kept until the watermark passes its time,
and a copy that comes later still is late and left out. When the watermark
reaches a workspace's expiry nothing can join it any more: it is handed on and
forgotten. A touch at the instant of expiry starts a new workspace.

Both states are Spark's own operators, so no touch goes through Python, and a
state has one row for each touch that can still be played again and one for
each open workspace, whatever its user's other touches. They live in the store
of the query's checkpoint, so a lost executor's users go on elsewhere from the
last batch.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: State in RocksDB, outside the heap; its rows are not counted, which would read each before it is written.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def expiring_workspaces(touches: DataFrame, user: str, touch_id: str, at: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """user, first_at, last_at, expires_at, touches of each workspace as it expires. touches: a stream; null times are left out."""
    rows = touches.where(F.col(at).isNotNull() & F.col(user).isNotNull())
    rows = rows.select(F.col(user).alias("user"), F.col(touch_id).cast("long").alias("touch_id"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    gap = hours * 3600 * 1_000_000
    # Windows that meet are one, so theirs are a microsecond short.
    window = F.session_window("at", f"{gap - 1} microseconds")
    closed = rows.dropDuplicates(["user", "touch_id", "at"]).groupBy("user", window).agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("touches"))
    return closed.select(F.col("user").alias(user), F.col("session_window.start").alias("first_at"), "last_at", F.timestamp_micros(F.unix_micros("last_at") + gap).alias("expires_at"), "touches")


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB."""
    had = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in had.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what expires to a table; runs through what is there and ends."""
    with state_store(stream.sparkSession):
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
