"""Retries as a stream: a failed row comes again after its delay and stops after its last attempt."""

import json

from postloom.streaming.retries import retried


def test_failed_rows_come_again_and_stop(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    at = lambda s: f"2024-05-01T00:{s // 60:02d}:{s % 60:02d}Z"

    def land(name, *rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"id": i, "status": status, "attempt": attempt, "at": at(s)}) for i, status, attempt, s in rows))
        stream = spark.readStream.schema("id string, status string, attempt int, at timestamp").json(str(tmp_path / "in"))
        out = retried(stream, delays=(20, 40), patience=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start().awaitTermination()

    land("a", ("a", "new", None, 0), ("b", "new", None, 0), ("c", "new", None, 1), (None, "new", None, 1))
    land("b", ("a", "failed", 1, 5), ("b", "done", 1, 6), ("a", "failed", 1, 7))
    land("c", ("t", "other", 1, 24))  # a's second attempt is due at 25 only
    land("d", ("t", "other", 1, 30))
    land("e", ("a", "failed", 2, 35), ("b", "failed", 1, 36))
    land("f", ("t", "other", 1, 80))
    land("g", ("a", "failed", 3, 90))
    land("h", ("t", "other", 1, 500))
    land("i", ("t", "other", 1, 501))  # a timer that is set by a timer fires in the next batch
    seen = spark.read.parquet(str(tmp_path / "out")).selectExpr("id", "attempt", "event", "unix_seconds(at) - unix_seconds(timestamp'2024-05-01 00:00:00') as s").collect()
    told = {i: [(r.attempt, r.event, r.s) for r in sorted(seen, key=lambda r: (r.s, r.attempt)) if r.id == i] for i in "abc"}
    assert told["a"] == [(1, "send", 0), (2, "send", 25), (3, "send", 75), (3, "given up", 90)]
    assert told["b"] == [(1, "send", 0), (1, "done", 6)]
    assert told["c"][:2] == [(1, "send", 1), (2, "send", 121)]  # never answered: failed at 101, again 20 later
    assert len(seen) == sum(map(len, told.values()))
