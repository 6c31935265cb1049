"""Streams over a restart."""

import datetime

from graphlens.streaming import runs
from graphlens.streaming.run import ROCKSDB, drain

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "run_id bigint, seq bigint, status string, ts timestamp"


def test_stuck_runs_go_on_from_their_checkpoint(spark, tmp_path):
    """What is known before a restart counts after it: open runs, their timers, and later changes of theirs."""
    rows = lambda *r: [(i, s, status, AT + datetime.timedelta(seconds=at)) for i, s, status, at in r]
    arrivals = [
        rows((1, 1, "queued", 0), (2, 1, "running", 0), (3, 1, "queued", 0), (3, 2, "running", 5), (4, 1, "queued", 0), (9, 1, "success", 900)),
        rows((4, 2, "success", 10), (1, 2, "running", 400), (9, 2, "success", 1000)),  # 1 was reported as queued before
        rows((9, 3, "success", 4000)),
        rows((5, 1, "queued", 3800), (9, 4, "success", 9000)),
    ]
    folder, home, known, found = str(tmp_path / "in"), str(tmp_path / "home"), set(), []
    for part in arrivals:  # a stream of its own each time, as after a restart
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        changes = spark.readStream.schema(SCHEMA).parquet(folder)
        rows = drain(runs.stuck_runs(changes), "stuck", state_store=ROCKSDB, home=home).collect()
        now = {(r.run_id, r.action, int((r.since - AT).total_seconds())) for r in rows}
        assert len(rows) == len(now) and known <= now
        found.append(now - known)
        known = now
    # watermarks (ten minutes back): 300 s, 400 s, 3400 s, 8400 s
    assert found == [{(1, "requeue", 0), (4, "requeue", 0)}, set(), {(1, "fail", 400), (2, "fail", 0), (3, "fail", 5)}, {(5, "requeue", 3800)}]
