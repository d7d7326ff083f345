"""Workspaces that expire: activity sessions, sweeps, orphans, cascades.

A row is expired from the instant on that its expiry names (expires_at <= now);
an expiry that is missing or can't be read never comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import parse_time


def expired(expires_at, now) -> Column:
    return F.coalesce(F.col(expires_at) <= now, F.lit(False)) if isinstance(expires_at, str) else F.coalesce(expires_at <= now, F.lit(False))


def sessions(events: DataFrame, user: str, at: str, hours: int = 24) -> DataFrame:
    """user, session_no, first_at, last_at, expires_at, touches: each touch moves the expiry; one at the instant of expiry starts anew."""
    order = W.partitionBy(user).orderBy(at)
    gap = F.make_dt_interval(hours=F.lit(hours))
    fresh = F.lag(at).over(order)
    starts = F.when(fresh.isNull() | (F.col(at) >= fresh + gap), 1).otherwise(0)
    rows = events.where(F.col(at).isNotNull()).withColumn("_s", starts).withColumn("session_no", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(user, "session_no").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("touches"))
    return out.withColumn("expires_at", F.col("last_at") + gap)


def active_workspaces(documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Per owner the workspace touched last, if it hasn't expired; and all others, which go."""
    order = W.partitionBy("owner").orderBy(F.col("last_activity_at").desc_nulls_last(), F.col("document_id"))
    rows = documents.withColumn("_r", F.row_number().over(order)).withColumn("_keep", (F.col("_r") == 1) & ~expired("expires_at", now))
    return rows.where("_keep").drop("_r", "_keep"), rows.where(~F.col("_keep")).drop("_r", "_keep")


def visible(documents: DataFrame, owner: Column, now: Column) -> DataFrame:
    return documents.where((F.col("owner") == owner) & ~expired("expires_at", now))


def access(requests: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """What a request for a document (document_id, user) gets: 200, 410 for one's own expired workspace, 404 for unknown and foreign ones alike."""
    rows = requests.join(documents.select("document_id", "owner", "expires_at"), "document_id", "left")
    own = F.coalesce(F.col("owner") == F.col("user"), F.lit(False))
    return rows.select("document_id", "user", F.when(~own, 404).when(expired("expires_at", now), 410).otherwise(200).alias("status"))


def listing(documents: DataFrame, owner: Column, now: Column) -> DataFrame:
    """An owner's documents that have not expired, the ones touched last first; ties by name."""
    return visible(documents, owner, now).orderBy(F.col("last_activity_at").desc_nulls_last(), "document_id")


def with_visible_parent(rows: DataFrame, documents: DataFrame, owner: Column, now: Column) -> DataFrame:
    """Rows of a child table for which a visible document exists."""
    return rows.join(visible(documents, owner, now).select("document_id"), "document_id", "left_semi")


def sweep(documents: DataFrame, indexes: DataFrame, uploads: DataFrame, caches: DataFrame, traces: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a sweep deletes: expired documents, and whatever no live document or index refers to. Running it again finds nothing new."""
    gone = documents.where(expired("expires_at", now))
    live = documents.join(gone.select("document_id"), "document_id", "left_anti")
    live_indexes = indexes.join(live.select("document_id"), "document_id", "left_semi")
    return {
        "documents": gone,
        "indexes": indexes.join(live_indexes.select("fingerprint"), "fingerprint", "left_anti"),
        "uploads": uploads.join(live.select("path"), "path", "left_anti"),
        "caches": caches.join(live_indexes.select("fingerprint"), "fingerprint", "left_anti"),
        "traces": traces.where(expired("expires_at", now)).unionByName(traces.where(~expired("expires_at", now)).join(live.select("document_id"), "document_id", "left_anti")),
    }


def sweep_summary(swept: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in swept.items():
        one = rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("category"), "deleted")
        out = one if out is None else out.unionByName(one)
    return out


def cascade(parents: DataFrame, children: dict[str, DataFrame], key: str = "document_id") -> dict[str, DataFrame]:
    """The rows of each child table that go with deleted parents."""
    return {name: rows.join(parents.select(key), key, "left_semi") for name, rows in children.items()}


def backfill(documents: DataFrame, hours: int = 24) -> DataFrame:
    """Fills owner, activity and expiry from JSON metadata where the columns are empty; text that is no time stays null."""
    field = lambda name: F.nullif(F.get_json_object("metadata", f"$.{name}"), F.lit(""))
    active = F.coalesce("last_activity_at", parse_time(field("last_activity_at")), "created_at")
    return documents.withColumn("owner", F.coalesce("owner", field("owner"))).withColumn("last_activity_at", active).withColumn(
        "expires_at", F.coalesce("expires_at", parse_time(field("expires_at")), F.col("last_activity_at") + F.make_dt_interval(hours=F.lit(hours)))
    )
