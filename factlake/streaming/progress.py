"""Progress of jobs as streams."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from .limiter import keep_state

#: How many of the last transitions of a job are kept.
KEPT = 200


def job_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream, a few files at a time: the rate is bounded by files and trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(jobs: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each job id once; ids are forgotten when the watermark has passed them."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_progress(events: DataFrame, job: str, at: str, stage: str, percent: str) -> DataFrame:
    """The last stage of each job and its percent, at most 100."""
    return events.groupBy(job).agg(F.max_by(stage, at).alias(stage), F.least(F.lit(100), F.max_by(percent, at)).alias(percent))


def finished(events: DataFrame, stage: str, final: tuple[str, ...] = ("SUCCEEDED", "FAILED")) -> DataFrame:
    return events.where(F.col(stage).isin(*final))


class _Transitions(StatefulProcessor):
    def __init__(self, job: str, order: list[str], stage: str, types: dict[str, str], kept: int, ttl_ms: int | None):
        self.job, self.order, self.stage, self.types, self.kept, self.ttl_ms = job, order, stage, types, kept, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stage string", self.ttl_ms)
        self.history = handle.getListState("history", f"stage string, place {self.types[self.order[-1]]}", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = self.last.get()[0] if self.last.exists() else object()
        changed = []
        for i, stage in enumerate(rows[self.stage].tolist()):
            stage = None if pd.isna(stage) else stage
            if stage != last:
                changed.append(i)
                last = stage
        out = rows.iloc[changed]
        if changed:
            self.last.update((last,))
            before = [tuple(x) for x in self.history.get()] if self.history.exists() else []
            places = [x.item() if hasattr(x, "item") else x for x in out[self.order[-1]]]
            self.history.put((before + [(None if pd.isna(s) else s, p) for s, p in zip(out[self.stage], places)])[-self.kept :])
        n = len(list(self.history.get())) if self.history.exists() else 0
        if changed:
            yield out[[self.job, *self.order, self.stage]].assign(n_kept=n)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, job: str, order: list[str], stage: str, kept: int = KEPT, ttl_ms: int | None = None) -> DataFrame:
    """Of a stream the events at which a job's stage changes, each job's first included, with n_kept: how many transitions its history then
    holds. The last stage is a value and the history a list of at most `kept`, the oldest going first; with ttl_ms both go that
    long after the last change (such a query runs triggers without data too, to let state go). A trigger's events of a job are put in order; between triggers they are taken as they come. State and output survive a
    restart from the checkpoint."""
    keep_state(events.sparkSession)
    types = {c: events.schema[c].dataType.simpleString() for c in (job, stage, *order)}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (job, *order, stage)) + ", n_kept long"
    return events.select(job, *order, stage).groupBy(job).transformWithStateInPandas(_Transitions(job, order, stage, types, kept, ttl_ms), schema, "Append", "None" if ttl_ms is None else "processingTime")


class _Stopper(StreamingQueryListener):
    """Stops the query of one run, from a thread of its own, when it is told that all is done."""

    def __init__(self, done: threading.Event):
        self.done, self.query = done, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.done.is_set() and self.query is not None and str(event.progress.runId) == str(self.query.runId):
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        if self.done.is_set() and self.query is not None and str(event.runId) == str(self.query.runId):
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryTerminated(self, event) -> None:
        pass


def poll_until_done(events: DataFrame, jobs: DataFrame, job: str, stage: str, path: str, checkpoint: str, final: tuple[str, ...] = ("SUCCEEDED", "FAILED"), every: str = "1 second") -> StreamingQuery:
    """Follows a stream of job events until each of `jobs` is final, writes the final events under path, and stops by itself.

    Each trigger writes its final events to a folder of its own, over what a failed try of the same trigger left, so a restart counts
    none twice; then the jobs without a final event are counted, and a listener stops the query when none is left."""
    spark, done = events.sparkSession, threading.Event()

    def step(batch: DataFrame, n: int) -> None:
        finished(batch, stage, final).write.mode("overwrite").parquet(f"{path}/batch={n}")
        seen = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if jobs.select(job).join(seen.select(job).distinct(), job, "left_anti").isEmpty():
            done.set()

    stopper = _Stopper(done)
    spark.streams.addListener(stopper)
    stopper.query = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    return stopper.query
