"""A limiter whose window opens with a key's first event, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_NEVER = -(1 << 62)


def allowed(times: np.ndarray, used: int, reset: int, most: int, length: int) -> tuple[np.ndarray, int, int]:
    """For the sorted times of one key, after `used` events of a window that ends at `reset`: which are allowed, and the state after them.
    A window is one step, however many events it has."""
    out, i = np.zeros(len(times), bool), 0
    while i < len(times):
        if times[i] > reset:
            used, reset = 0, int(times[i]) + length
        j = int(np.searchsorted(times, reset, "right"))
        n = min(max(most - used, 0), j - i)
        out[i : i + n] = True
        used, i = used + n, j
    return out, used, reset


def limit_events(events: DataFrame, key: str, at: str, order: str, most: int, length: int) -> DataFrame:
    """Each event with `allowed`: of a key's events from the one that opens a window up to `length` later, the first `most`. The
    next event after that opens a new one. Times are integers; null ones count as the earliest.

    A scan over events sorted by key and time, in batches: what passes from one to the next is the count and the end of the open window,
    so a key of any number of events needs no more memory than a batch."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, reset = object(), 0, _NEVER
        for batch in batches:
            keys, times = batch.column(0).to_pandas().to_numpy(dtype=object), batch.column(1).fill_null(_NEVER + 1).to_numpy()
            ends = np.append(np.flatnonzero([a is not b and a != b for a, b in zip(keys[1:], keys[:-1])]) + 1, len(keys)) if len(keys) else []
            out, lo = [], 0
            for hi in ends:
                if keys[lo] is not last and keys[lo] != last:
                    last, used, reset = keys[lo], 0, _NEVER
                ok, used, reset = allowed(times[lo:hi], used, reset, most, length)
                out.append(ok)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.bool_())], names=[*batch.schema.names, "allowed"])

    rows = events.select(key, F.col(at).cast("long").alias(at), order).repartition(key).sortWithinPartitions(key, at, order)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{at}` long, `{order}` {kinds[order]}, allowed boolean")


def keep_state(spark: SparkSession) -> None:
    """The state store that holds values, lists and timers of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Limiter(StatefulProcessor):
    """Events wait in a list until the watermark has passed them and are then taken in order of time; the window is a value, which a
    timer clears when no event can fall in it any more."""

    def __init__(self, key: str, at: str, order: str, most: int, length: int, kind: str):
        self.key, self.at, self.order, self.most, self.length, self.kind = key, at, order, most, length, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "used long, reset long")
        self.waiting = handle.getListState("waiting", f"at long, ord {self.kind}")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            times = part[self.at].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(times.tolist(), part[self.order].tolist())))
            self._wake(int(times.min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in rows if x[0] < past], [x for x in rows if x[0] >= past]
        used, reset = self.window.get() if self.window.exists() else (0, _NEVER)
        ok, used, reset = allowed(np.array([x[0] for x in due], np.int64), int(used), int(reset), self.most, self.length)
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if reset >= past:
            self.window.update((used, reset))
            self._wake(reset)
        elif self.window.exists():
            self.window.clear()
        if due:
            yield pd.DataFrame({self.key: [key[0]] * len(due), self.at: pd.to_datetime([x[0] for x in due], unit="us"), self.order: [x[1] for x in due], "allowed": ok})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, at: str, order: str, most: int, length: int, late: str = "1 hour") -> DataFrame:
    """limit_events over a stream whose events come in any order, up to `late`: `at` is a timestamp and length in microseconds. An event is
    answered when the watermark has passed it, so the rows are those of the batch over the same events; later ones are dropped. State
    goes by event-time timers: a key that has no open window and nothing waiting holds none."""
    keep_state(events.sparkSession)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    schema = f"`{key}` {kinds[key]}, `{at}` timestamp, `{order}` {kinds[order]}, allowed boolean"
    rows = events.select(key, at, order).withWatermark(at, late).groupBy(key)
    return rows.transformWithStateInPandas(_Limiter(key, at, order, most, length, kinds[order]), schema, "Append", "EventTime")
