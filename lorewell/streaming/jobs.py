"""Streams of files, requests and job events, and the batch walk of the token bucket."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from lorewell.functions import scalars as S
from lorewell.operators import corpus


def token_bucket(requests: DataFrame, period: int, burst: int) -> DataFrame:
    """requests(id, key, at: microseconds) -> id, key, accepted, wait: a token returns every period microseconds, a bucket
    holds burst of them and starts full, a request takes one or waits (1 ms at least).

    Keys are hashed to tasks, sorted there by time, and walked as a stream that holds one number per task: no key's
    requests are collected. All arithmetic is in whole microseconds. A request without a time is left out."""
    kinds, full = dict(requests.dtypes), period * burst

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level, last = object(), full, 0
        for f in frames:
            accepted, wait = [], []
            for k, at in zip(f["key"], f["at"].tolist(), strict=True):
                if k != key:
                    key, level, last = k, full, at
                level, last = min(full, level + at - last), at
                ok = level >= period
                accepted.append(ok)
                wait.append(0 if ok else max(1000, period - level))
                level -= period if ok else 0
            yield pd.DataFrame({"id": f["id"], "key": f["key"], "accepted": accepted, "wait": wait})

    rows = requests.filter("at is not null and key is not null").select("id", "key", "at").repartition("key").sortWithinPartitions("key", "at", "id")
    return rows.mapInPandas(work, f"id {kinds['id']}, key {kinds['key']}, accepted boolean, wait long")


def accepted_requests(requests: DataFrame, within: str = "5 minutes") -> DataFrame:
    """A stream of (ts, source_id, commit): the first of equal requests within the time. Later than the watermark: dropped."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["source_id", "commit"])


def job_states(events: DataFrame) -> DataFrame:
    """The latest status of each job; for outputMode('update') or ('complete')."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def _sets() -> dict[str, tuple[Column, Column]]:
    """Of each column of a job's record: which events set it, and to what."""
    running, done, failed = (F.col("kind") == k for k in ("progress", "complete", "fail"))
    return {
        "status": (running | done | failed, F.when(running, "running").when(done, "completed").otherwise("failed")),
        "progress_percent": (running | done, F.when(done, 100).otherwise(F.col("percent").cast("int"))),
        "processed_files": (running, F.col("processed").cast("int")),
        "total_files": (running, F.col("total").cast("int")),
        "error_message": (failed, F.col("error").cast("string")),
        "finished_at": (done | failed, F.col("ts").cast("timestamp")),
    }


RECORD = "status string, progress_percent int, processed_files int, total_files int, error_message string, finished_at timestamp"


def job_records(events: DataFrame) -> DataFrame:
    """events(job_id, ts, event_id, kind: progress, complete or fail, percent, processed, total, error) -> job_id and RECORD.

    Progress makes a job run and sets percent and counts; completion sets 100 and the time; failure sets message and time
    and leaves the percent. Each column holds what the latest event (by ts, then event_id) that sets it says, so the order in which
    events arrive doesn't matter and partial results merge before the shuffle. Other kinds set nothing; events without a
    job or a time are left out."""
    order = F.struct("ts", "event_id")
    cols = [F.max_by(value, F.when(sets, order)).alias(c) for c, (sets, value) in _sets().items()]
    return events.filter("job_id is not null and ts is not null").groupBy("job_id").agg(*cols).filter("status is not null")


class _JobRecord(StatefulProcessor):
    """One JSON value a job: each column's value with the time and id of the event that set it. Events merge by maximum, so
    late and repeated ones do no harm. A job that nothing is heard of for ttl_ms is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", StructType([StructField("held", StringType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {}
        for frame in rows:
            for made in frame["made"]:
                for x in json.loads(made):
                    order = [x["at"], x["id"]]
                    if x["c"] not in held or order > held[x["c"]][0]:
                        held[x["c"]] = [order, x["v"]]
        self.state.update((json.dumps(held),))
        yield pd.DataFrame({"job_id": [key[0]], "record": [json.dumps({c: v for c, (_, v) in held.items()})]})

    def close(self) -> None:
        pass


def job_record_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """job_records() of a stream, for outputMode('update'): a job's whole record whenever an event comes in. ttl_ms forgets
    jobs by processing time, for a trigger by time (with availableNow such a query finds no end). Needs the RocksDB state store."""
    kind = dict(events.dtypes)["job_id"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    each = [F.when(sets, F.struct(F.lit(c).alias("c"), at.alias("at"), F.col("event_id").cast("long").alias("id"), (F.unix_micros(v) if c == "finished_at" else v).cast("string").alias("v"))) for c, (sets, v) in _sets().items()]
    made = F.to_json(F.filter(F.array(*each), lambda x: x.isNotNull()), {"ignoreNullFields": "false"})
    rows = events.filter("job_id is not null and ts is not null").select("job_id", made.alias("made")).filter("made <> '[]'")
    out = rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_JobRecord(ttl_ms), outputStructType=f"job_id {kind}, record string", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
    r = F.from_json("record", "map<string,string>")
    when = F.timestamp_micros(r["finished_at"].cast("long")).alias("finished_at")
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = dict(c.split() for c in RECORD.split(", "))
    return out.select("job_id", *[when if c == "finished_at" else r[c].cast(kinds[c]).alias(c) for c in names])


PUSH = "ref string, after string, repository struct<full_name:string, name:string, owner:struct<login:string, name:string>>"


def push_events(payloads: DataFrame) -> DataFrame:
    """(event, body) -> repository, branch, commit of pushes; pings and other events are left out, as are bad bodies."""
    p = payloads.filter("event = 'push'").select(F.from_json("body", PUSH).alias("p")).filter("p.ref is not null")
    slug = F.coalesce("p.repository.full_name", F.concat_ws("/", F.coalesce("p.repository.owner.login", "p.repository.owner.name"), "p.repository.name"))
    return p.select(slug.alias("repository"), S.push_branch(F.col("p.ref")).alias("branch"), F.col("p.after").alias("commit"))


def ingest_sync(existing: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """existing and scanned(project_id, file_path, language, text, content_hash) -> (diff, chunks of what was added or
    modified). An unchanged file isn't chunked again, so running it twice gives no chunks."""
    diff = corpus.sync_diff(existing, scanned)
    todo = diff.filter(F.col("change").isin("added", "modified")).select("project_id", "file_path")
    files = scanned.join(todo, ["project_id", "file_path"], "left_semi").select(F.concat_ws("/", "project_id", "file_path").alias("id"), "text", "language")
    return diff, corpus.chunk_documents(files)


def stream_sync(files: DataFrame, existing: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of scanned files is held against the table as it is then; write(diff, chunks) replaces what
    changed. Files that aren't in a batch aren't taken as deleted. Replays find equal hashes and change nothing."""

    def step(batch: DataFrame, _: int) -> None:
        diff, chunks = ingest_sync(existing(), batch)
        write(diff.filter("change <> 'deleted'"), chunks)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
