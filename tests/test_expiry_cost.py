"""Sliding expiry: no touch goes through Python, and what a touch played again is."""

import datetime

from lodestone.streaming.expiry import expiring_workspaces, run_to_end

SCHEMA = "touch_id long, user_id long, ts timestamp"
START = datetime.datetime(2026, 1, 1)


def test_state_is_sparks_own_and_identifiers_may_recur(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    # Touch 1 comes again as it was, and its identifier once more at another time, as in the SQL another touch.
    rows = [(1, 7, START), (1, 7, START), (1, 7, START + 3 * hour), (2, 7, START + 30 * hour), (3, 8, START + 24 * 30 * hour)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    closed = expiring_workspaces(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "user_id", "touch_id", "ts")
    plan = closed._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "SessionWindow" in plan.title().replace("_", "")
    run_to_end(closed, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("first_at").select("user_id", "first_at", "expires_at", "touches").collect()
    assert [tuple(r) for r in found] == [(7, START, START + 27 * hour, 2), (7, START + 30 * hour, START + 54 * hour, 1)]


def test_the_session_keeps_its_own_state_store(spark):
    from lodestone.streaming.expiry import STORE, state_store

    before = {name: spark.conf.get(name, None) for name in STORE}
    with state_store(spark):
        assert {name: spark.conf.get(name) for name in STORE} == STORE
    assert {name: spark.conf.get(name, None) for name in STORE} == before
