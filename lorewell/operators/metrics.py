"""Figures that a run leaves behind while it does its work: observed on batches, and summed up over streams."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lorewell.sources.staging import staged

CHANGES, STATES = ("added", "modified", "unchanged", "deleted"), ("running", "completed", "failed")


def watched(df: DataFrame, name: str, **figures) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the figures (aggregates) once df has been read through."""
    seen = Observation(name)
    return df.observe(seen, *[f.alias(c) for c, f in figures.items()]), seen


def counts_of(column: str, names: tuple[str, ...], before: str) -> dict:
    return {f"{before}{n}": F.count_if(F.col(column) == n) for n in names}


def sync_metrics(diff: DataFrame, chunks: DataFrame, jobs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row of figures, and the three tables, each read once: files by change of diff(change), chunks, their tokens and
    those with a vector of chunks(token_count, vector), jobs by status of jobs(status). The figures come from the
    observations of the very pass that stages the tables, so no second scan counts anything."""
    diff, files = watched(diff, "files", **counts_of("change", CHANGES, "files_"))
    chunks, made = watched(chunks, "chunks", chunks=F.count("*"), tokens=F.coalesce(F.sum("token_count"), F.lit(0)).cast("long"), embeddings=F.count("vector"))
    jobs, states = watched(jobs, "jobs", **counts_of("status", STATES, "jobs_"))
    tables = {k: staged(v) for k, v in (("diff", diff), ("chunks", chunks), ("jobs", jobs))}
    row = files.get | made.get | states.get
    return diff.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row)), tables


class StreamMetrics(StreamingQueryListener):
    """Sums up what streams observe (see watched()), over their batches: totals[name of the observation][figure]. A figure
    of a batch that was run again after a failure counts once: the last that was told."""

    def __init__(self):
        self._seen: dict[tuple, dict] = {}

    @property
    def totals(self) -> dict[str, Counter]:
        out: dict[str, Counter] = {}
        for (_, _, name), figures in self._seen.items():
            out.setdefault(name, Counter()).update(figures)
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            self._seen[(str(p.id), p.batchId, name)] = {c: v or 0 for c, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
