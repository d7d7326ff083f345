"""The streaming side of retention: sessions as events arrive, and expired traces as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import store


def session_stream(events: DataFrame, user: str = "user_id", at: str = "ts", hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream of events. The gap is a microsecond short of `hours`: a touch at the instant of expiry starts a new session."""
    gap = f"{hours * 3600 * 1_000_000 - 1} microseconds"
    window = F.session_window(F.col(at), gap)
    rows = events.withWatermark(at, late).groupBy(F.col(user), window).agg(F.count(F.lit(1)).alias("touches"))
    end = F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND")
    return rows.select(user, F.col("session_window.start").alias("first_at"), end.alias("expires_at"), "touches")


def events_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append closed rows to a table; runs through what is there and ends."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_sweeper(stream: DataFrame, path: str, checkpoint: str):
    """For each batch of ticks (now) the expired traces go from the records under path.

    Each sweep writes the next version of the table; a crash on the way leaves the
    last one, and a batch that is played again finds nothing new.
    """

    def sweep(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("now")).first()[0]
        records = store(batch.sparkSession, path, "traces")
        rows = records.rows()
        if now is not None and rows is not None:
            records.put(rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))

    return stream.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
