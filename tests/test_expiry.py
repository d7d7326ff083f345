"""Sliding expiry as a stream equals the sessions of the whole table."""

import datetime
import random

from pyspark.sql import functions as F

from lodestone.operators import retention
from lodestone.streaming.expiry import expiring_workspaces, run_to_end

SCHEMA = "touch_id long, user_id long, ts timestamp"


def written(spark, tmp_path, batches):
    """Each batch as a file of its own, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k:03d}"))
    return str(tmp_path / "in")


def expired(spark, tmp_path, batches, late="2 hours"):
    at = written(spark, tmp_path, batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(at)
    run_to_end(expiring_workspaces(stream, "user_id", "touch_id", "ts", late=late), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.user_id, r.first_at, r.last_at, r.expires_at, r.touches) for r in rows)


def test_shuffled_late_and_replayed_touches(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    touches = []
    for user in range(8):
        at = start + datetime.timedelta(minutes=rng.randrange(600))
        for _ in range(30):
            touches.append((len(touches), user, at))
            # Some come exactly at the expiry, some a little before it.
            at += rng.choice([datetime.timedelta(hours=24), datetime.timedelta(hours=24, microseconds=-1000), datetime.timedelta(minutes=rng.randrange(1, 2000))])
    end = max(t[2] for t in touches)
    touches.sort(key=lambda t: t[2])
    # Out of order by up to the watermark's delay, in batches, and some again in a later batch.
    shuffled = sorted(touches, key=lambda t: t[2] + datetime.timedelta(minutes=rng.randrange(0, 119)))
    size = 60
    batches = [shuffled[i : i + size] for i in range(0, len(shuffled), size)]
    batches = [b + rng.sample(batches[max(0, k - 1)], 5) + [(None, None, None)] for k, b in enumerate(batches)]
    batches.append([(10**9, 99, end + datetime.timedelta(days=30))])
    got = expired(spark, tmp_path, batches)
    whole = spark.createDataFrame(touches, SCHEMA)
    want = sorted((r.user_id, r.first_at, r.last_at, r.expires_at, r.touches) for r in retention.sessions(whole, "user_id", "ts").collect())
    assert got == want and len(want) > 40
