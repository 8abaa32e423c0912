"""Streams: rows that come too late, keys that stay away, and batches that are finished."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from millrace.streaming import events


def test_late_rows_are_left_out_and_batches_finished(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[(at(1), 1), (at(1, 30), 2)], [(at(9), 3)], [(at(1, 40), 4), (at(9, 10), 5)]]
    schema, finished = "ts timestamp_ntz, v int", []
    source = tmp_path / "in"
    source.mkdir()
    stream = events.timed(spark.readStream.schema(schema).parquet(str(source)), F.col("ts"), "1 hour")
    out = events.tumbling(stream, "1 hour", [], n=F.count("*"), total=F.sum("v"))
    query = events.finish_batches(out, lambda b, n: finished.append((n, [(r.window_start.hour, r.total) for r in b.collect()])), "update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
            assert finished, i
    finally:
        query.stop()
    told = [x for _, rows in finished for x in rows]
    assert (1, 3) in told and (9, 3) in told and (9, 8) in told
    assert (1, 7) not in told  # hour 1 was over when its last row came


def test_a_key_that_stays_away_is_told_once_more_and_forgotten(spark, tmp_path):
    source, told = tmp_path / "in", []
    source.mkdir()
    counts = events.running_counts(spark.readStream.schema("k string").parquet(str(source)), "k", timeout_ms=500)
    query = events.finish_batches(counts, lambda b, n: told.extend(map(tuple, b.collect())), "update").option("checkpointLocation", str(tmp_path / "state")).start()

    def put(*keys):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(str(source))

    def comes(row):
        until = time.monotonic() + 60
        while row not in told and time.monotonic() < until:
            time.sleep(0.1)
        assert row in told

    try:
        put("a", "a", "b")
        comes(("a", 2, True))
        put("a")
        comes(("a", 1, False))  # forgotten, then counted anew
    finally:
        query.stop()
    assert {("a", 2, False), ("b", 1, False)} <= set(told)
