import datetime as dt

import pytest

from quernlight.streaming import timers

START = dt.datetime(2024, 1, 1)
ROWS = [
    (1, 0, "context_discovered"), (2, 0, "context_discovered"), (3, 0, "error"), (1, 10, "start_planning"),
    (2, 50, "nonsense"), (1, 40, "start_execution"), (4, 55, "context_discovered"), (4, 56, None), (None, 56, "error"),
    (1, 120, "start_verification"), (5, 130, "context_discovered"), (4, 131, "recover"),
    (1, 400, "recover"), (6, 1000, "context_discovered"),
]
SCHEMA = "session_id long, at timestamp, trigger string"


def rows(part):
    return [(k, START + dt.timedelta(minutes=m), t) for k, m, t in part]


def test_fold():
    assert timers.fold(timers._NEW, [(0, "context_discovered"), (9, "start_planning")], 10) == ("planning", 2, 0, 0, 9)
    assert timers.fold(timers._NEW, [(0, "context_discovered"), (10, "start_planning")], 10) == ("failed", 1, 1, 1, 10)
    assert timers.fold(timers._NEW, [(0, "error"), (99, "recover")], 10) == ("ready", 2, 0, 0, 99)


@pytest.fixture
def store(spark):
    before = spark.conf.get(timers.STORE[0])
    spark.conf.set(*timers.STORE)
    yield
    spark.conf.set(timers.STORE[0], before)


def test_stuck_sessions_fail_across_a_restart(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, fired = {}, []

    def keep(df, _):
        for r in df.collect():
            fired.append(r["session_id"])
            got[r["session_id"]] = tuple(r)

    for part in (ROWS[:4], ROWS[4:9], ROWS[9:12], ROWS[12:]):  # a run for each, from the checkpoint of the one before
        spark.createDataFrame(rows(part), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = timers.workflow_timers(log).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r["session_id"]: tuple(r) for r in timers.workflow_until(spark.createDataFrame(rows(ROWS), SCHEMA)).collect()}
    assert got == want
    assert want[2][1:] == ("failed", 1, 1, 1)  # nothing came after minute 50
    assert want[1][1] == "failed" and want[1][4] == 2 and want[6][1] == "ready" and want[3][1:] == ("failed", 1, 0, 0)
    assert fired.count(5) == 2  # once by its trigger, once by its timer
