"""Watching sources: saves as a stream, debounced by watcher, with a cooldown by path.

A save is a row (watcher, path, ms) and, where its text matters, source. Saves come as
files of their own (``publish``), since a file stream sees each name once: an edited
source is a new save. Folds over saves in order run in sorted partitions, one row at a
time, or as the state of a stream; they hold what is pending and no history.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.operators.tables import ignored
from lineament.sources.files import supported

DEBOUNCE_MS = 300
COOLDOWN_MS = 2000
SAVES = "watcher string, path string, ms long, source string"


def publish(folder: str, path: str, source: str, watcher: str = "", ms: int | None = None) -> None:
    """Write one save; the file appears whole."""
    row = {"watcher": watcher, "path": path, "ms": int(time.time() * 1000) if ms is None else ms, "source": source}
    file = Path(folder) / f"{uuid.uuid4().hex}.json"
    part = file.with_name("." + file.name)
    part.write_text(json.dumps(row))
    part.rename(file)


def source_stream(spark: SparkSession, folder: str, patterns: list[str] | None = None) -> DataFrame:
    """Saves of sources that no pattern ignores, as they are published."""
    saves = spark.readStream.schema(SAVES).json(folder)
    return saves.where(supported(F.col("path")) & ~ignored(F.col("path"), patterns or []))


def watch(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[Exception, int], None] | None = None):
    """Start the query: each micro-batch keeps the newest save of each path and hands its analysis to ``sink``.

    What comes while a batch is analysed waits for the next one: a batch is a drained queue. An error goes
    to ``on_error`` and the watch goes on; without it the error ends the query."""

    def batch(df: DataFrame, number: int) -> None:
        newest = df.groupBy("path").agg(F.max_by("source", "ms").alias("source"))
        units = newest.select(F.xxhash64("path").alias("unit_id"), "path", "source")
        try:
            sink(analyse(units), number)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e, number)

    return stream.writeStream.foreachBatch(batch).trigger(processingTime=f"{DEBOUNCE_MS} milliseconds").option("checkpointLocation", checkpoint).start()


# Folds over saves in order. -------------------------------------------------------------


class Debounce:
    """The first save sets a deadline that later ones do not move; when it has passed, every pending path is analysed once."""

    def __init__(self) -> None:
        self.deadline: int | None = None
        self.pending: dict[str, None] = {}

    def save(self, path, ms: int) -> list[tuple]:
        out = self.fire(ms)
        if self.deadline is None:
            self.deadline = ms + DEBOUNCE_MS
        self.pending[path] = None
        return out

    def fire(self, now: int | None) -> list[tuple]:
        """(path, ms) of the analyses that are due; of all for None."""
        if self.deadline is None or (now is not None and now < self.deadline):
            return []
        out = [(p, self.deadline) for p in self.pending]
        self.deadline, self.pending = None, {}
        return out


def _folded(events: DataFrame, key: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (key, path, ms) of each key in order of time, given to ``fold`` one after another."""
    rows = events.select(F.col(key).alias("key"), "path", "ms").repartition("key").sortWithinPartitions("key", "ms", "path")

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        made: list[tuple] = []
        for row in fold(each()):
            made.append(row)
            if len(made) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "ms"])
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "ms"])

    return rows.mapInArrow(run, schema)


def debounced(events: DataFrame, watcher: str) -> DataFrame:
    """path and ms of the analyses that saves (watcher, path, ms) lead to, without the cooldown."""

    def fold(rows):
        last, state = None, Debounce()
        for key, path, ms in rows:
            if key != last:
                yield from state.fire(None)
                last, state = key, Debounce()
            yield from state.save(path, ms)
        yield from state.fire(None)

    return _folded(events, watcher, fold, f"path {events.schema['path'].dataType.simpleString()}, ms long")


def cooled(events: DataFrame) -> DataFrame:
    """Saves that are analysed when those within the cooldown of the last analysis of their path are dropped."""

    def fold(rows):
        last = at = None
        for _, path, ms in rows:
            if path != last or at is None or ms - at >= COOLDOWN_MS:
                yield path, ms
                last, at = path, ms

    return _folded(events, "path", fold, f"path {events.schema['path'].dataType.simpleString()}, ms long")


def cooled_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the time of the last analysis as each path's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for ms in sorted(x for f in frames for x in f["ms"]):
            if last is None or ms - last >= COOLDOWN_MS:
                out.append(ms)
                last = ms
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"path": [key[0]] * len(out), "ms": out})

    kind = events.schema["path"].dataType.simpleString()
    return events.groupBy("path").applyInPandasWithState(step, f"path {kind}, ms long", "last long", "append", "NoTimeout")


def debounced_stream(events: DataFrame) -> DataFrame:
    """Debouncing over a stream of (watcher, path, ms): the deadline and the pending paths are each watcher's state.

    What is pending when the stream pauses is due at the watcher's next save, or when its timeout runs out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold, out = Debounce(), []
        if state.exists:
            deadline, pending = state.get
            fold.deadline, fold.pending = deadline, dict.fromkeys(json.loads(pending))
        if state.hasTimedOut:
            out += fold.fire(None)
        else:
            for ms, path in sorted((m, p) for f in frames for m, p in zip(f["ms"], f["path"])):
                out += fold.save(path, int(ms))
        if fold.deadline is None:
            state.remove()
        else:
            state.update((fold.deadline, json.dumps(list(fold.pending))))
            state.setTimeoutDuration(DEBOUNCE_MS)
        yield pd.DataFrame({"path": [p for p, _ in out], "ms": [m for _, m in out]})

    return events.groupBy("watcher").applyInPandasWithState(step, "path string, ms long", "deadline long, pending string", "append", "ProcessingTimeTimeout")
