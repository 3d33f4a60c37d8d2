"""Job records as a stream and as a batch, and requests that are taken once a period."""

import random

import pytest
from lorewell.operators.requests import accepted_once
from lorewell.streaming import jobs

KIND = "job_id string, ts timestamp, event_id int, kind string, percent int, processed int, total int, error string"
ROWS = [
    ("a", "2024-01-01 00:00:01", 1, "progress", 10, 1, 9, None), ("a", "2024-01-01 00:00:03", 3, "complete", None, None, None, None), ("a", "2024-01-01 00:00:02", 2, "progress", 50, 5, 9, None),  # the last one is late
    ("b", "2024-01-01 00:00:01", 4, "progress", 30, 3, 7, None), ("b", "2024-01-01 00:00:01", 5, "fail", None, None, None, "gone"), ("b", "2024-01-01 00:00:01", 5, "fail", None, None, None, "gone"),
    ("c", "2024-01-01 00:00:01", 6, "other", 1, 1, 1, "x"), (None, "2024-01-01 00:00:01", 7, "fail", None, None, None, "x"), ("d", None, 8, "fail", None, None, None, "x"),
]
WANT = [("a", "completed", 100, 5, 9, None, 3), ("b", "failed", 30, 3, 7, "gone", 1)]


def told(rows):
    return sorted((r.job_id, r.status, r.progress_percent, r.processed_files, r.total_files, r.error_message, r.finished_at.second) for r in rows)


def events(spark, rows):
    return spark.createDataFrame(rows, KIND.replace("timestamp", "string")).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in KIND.split(", ")])


def test_job_records(spark):
    assert told(jobs.job_records(events(spark, ROWS)).collect()) == WANT
    assert jobs.job_records(events(spark, [])).count() == 0


def test_the_stream_of_job_records_ends_as_the_batch(spark, tmp_path):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate((ROWS[:2], ROWS[2:])):
            events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
            seen = {}
            note = lambda df, _, seen=seen: seen.update({r.job_id: r for r in df.collect()})
            q = jobs.job_record_stream(stream).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
            if i:
                assert told(seen.values()) == WANT  # only from the state of the run before can job a keep its end
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("seed", range(3))
def test_requests_are_taken_once_a_period(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(0, 4000, 1 + seed)])) for i in range(400)] + [(900, "x", 0), (901, "x", 240), (902, "x", 480)]
    want, last = {i: False for i, _, _ in rows}, {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= 300:
            want[i], last[k] = True, t
    got = {r.id: r.accepted for r in accepted_once(spark.createDataFrame(rows, "id int, key string, at long"), 300).collect()}
    assert got == want and got[902] and not got[901]
    assert accepted_once(spark.createDataFrame([], "id int, key string, at long"), 300).count() == 0
