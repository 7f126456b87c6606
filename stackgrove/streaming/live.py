"""Live forms: contexts and sketches kept as state of each thread by Structured Streaming.

A micro-batch has no order of its own: rows are sorted within it by (ts, seq). An event that comes
in a later batch than its successors is applied late. Each trigger gives snapshots, not each update.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import frame
from ..operators.sketches import ENGINES
from ..sources.events import ENTER, EXIT, ORDER

SNAPSHOT = "tid long, path string, counter long, monitored boolean"
_STATE = "stack string, paths array<string>, counters array<long>"


class Thread:
    """A thread's open frames and exact counters."""

    def __init__(self, stack: list[str] | None = None, counters: dict[str, int] | None = None):
        self.stack, self.counters = stack or [], counters or {}

    def apply(self, kind: str, name: str) -> str | None:
        if kind == ENTER:
            self.stack.append(name)
            path = "/".join(self.stack)
            self.counters[path] = self.counters.get(path, 0) + 1
            return path
        if kind == EXIT and self.stack:
            self.stack.pop()
        return None


def _ordered(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str]]:
    whole = pd.concat(list(pdfs)).sort_values(ORDER)
    return zip(whole["kind"], whole["frame"], strict=True)


def exact_snapshots(events: DataFrame) -> DataFrame:
    """tid, path, counter, monitored of each thread that had events in the micro-batch; streaming, mode update."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            stack, paths, counters = state.get
            thread = Thread(json.loads(stack), dict(zip(paths, counters, strict=True)))
        else:
            thread = Thread()
        touched = {p for kind, name in _ordered(pdfs) if (p := thread.apply(kind, name)) is not None}
        state.update((json.dumps(thread.stack), list(thread.counters), list(thread.counters.values())))
        found = sorted(touched)
        yield pd.DataFrame({"tid": key[0], "path": found, "counter": [thread.counters[p] for p in found], "monitored": True})

    rows = events.filter(F.col("kind").isin(ENTER, EXIT)).select("tid", *ORDER, "kind", frame(F.col("routine_id"), F.col("call_site")).alias("frame"))
    return rows.groupBy("tid").applyInPandasWithState(run, SNAPSHOT, _STATE, "update", "NoTimeout")


def sketch_snapshots(events: DataFrame, engine: str, size: int) -> DataFrame:
    """The same by a sketch: state is bounded by its size and the open stack. All its rows, each trigger."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import pickle

        thread, sketch = Thread(), ENGINES[engine](size)
        if state.exists:
            stack, kept = state.get
            thread.stack, sketch = json.loads(stack), pickle.loads(kept)
        for kind, name in _ordered(pdfs):
            if kind == ENTER:
                thread.stack.append(name)
                sketch.enter("/".join(thread.stack))
            elif thread.stack:
                thread.stack.pop()
        state.update((json.dumps(thread.stack), pickle.dumps(sketch)))
        rows = sorted(sketch.rows())
        yield pd.DataFrame({"tid": key[0], "path": [r[0] for r in rows], "counter": [r[1] for r in rows], "monitored": [r[2] for r in rows]})

    rows = events.filter(F.col("kind").isin(ENTER, EXIT)).select("tid", *ORDER, "kind", frame(F.col("routine_id"), F.col("call_site")).alias("frame"))
    return rows.groupBy("tid").applyInPandasWithState(run, SNAPSHOT, "stack string, sketch binary", "update", "NoTimeout")


def windowed_calls(events: DataFrame, length: str, late: str, slide: str | None = None, session: bool = False) -> DataFrame:
    """Enters by routine in windows of event time; rows later than `late` are left out.

    Windows tumble, or start each `slide`; with `session` they are a thread's, and end after `length` without an enter.
    """
    kept = events.filter(F.col("kind") == ENTER).withWatermark("ts", late)
    if session:
        found = kept.groupBy(F.session_window("ts", length).alias("window"), "tid", "routine_id")
        return found.agg(F.count("*").alias("enters")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tid", "routine_id", "enters")
    found = kept.groupBy(F.window("ts", length, slide), "routine_id") if slide else kept.groupBy(F.window("ts", length), "routine_id")
    return found.agg(F.count("*").alias("enters")).select(F.col("window.start").alias("start"), "routine_id", "enters")
