"""Calling contexts of enter events: stack depth, open frames and paths, from native expressions alone.

depth is the running sum of +1 and -1 less its running minimum (where that is below 0): exits on an
empty stack change nothing. The frame open at level k is the last one entered at depth k.

Threads that are too long for a task are cut into chunks, and a task has whole chunks, not whole threads. Within a
chunk depths are local; what a chunk does to any stack is some pops (minus the minimum) and then some
pushes (the frames open at its end). These effects, a short row each, are put in order for each
thread by the same rule, which gives the stack each chunk starts from; a path is as much of that
stack as the chunk has not popped yet, and the local frames above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import frame
from ..sources.events import ENTER, EXIT, ORDER

_THREAD = ["trace_id", "tid"]
_CHUNK = [*_THREAD, "_chunk"]
#: Result rows of threads put into one batch, about.
HELD = 10_000


def _in_order(*keys: str, upto_now: bool = True) -> Window:
    w = Window.partitionBy(*_THREAD, *keys).orderBy(*ORDER)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto_now else w


def with_depth(events: DataFrame) -> DataFrame:
    """Adds delta, depth (of the stack after the event) and underflow (an exit that found no frame)."""
    step = F.when(F.col("kind") == ENTER, 1).when(F.col("kind") == EXIT, -1).otherwise(0)
    summed = events.withColumn("delta", step).withColumn("_sum", F.sum("delta").over(_in_order()))
    low = F.least(F.lit(0), F.min("_sum").over(_in_order()))
    before = F.coalesce(F.lag("_low").over(_in_order(upto_now=False)), F.lit(0))
    return (
        summed.withColumn("_low", low)
        .withColumn("depth", (F.col("_sum") - F.col("_low")).cast("int"))
        .withColumn("underflow", (F.col("delta") == -1) & (F.col("_low") < before))
        .drop("_sum", "_low")
    )


def underflow_exits(events: DataFrame) -> DataFrame:
    """One row: how many exits found an empty stack."""
    return with_depth(events).agg(F.sum(F.col("underflow").cast("long")).alias("underflow_exits"))


def _in_chunks(events: DataFrame, chunk: Column) -> DataFrame:
    """Enters and exits with their chunk, local depth after them, frames popped below the chunk's start so far, and number."""
    step = F.when(F.col("kind") == ENTER, 1).otherwise(-1)
    rows = events.filter(F.col("kind").isin(ENTER, EXIT)).select(*_THREAD, *ORDER, "tick", step.alias("_step"), frame(F.col("routine_id"), F.col("call_site")).alias("frame"), chunk.alias("_chunk"))
    w = Window.partitionBy(*_CHUNK).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_sum", F.sum("_step").over(so_far)).withColumn("_n", F.row_number().over(w))
    return summed.withColumn("_pops", -F.least(F.lit(0), F.min("_sum").over(so_far))).withColumn("_depth", F.col("_sum") + F.col("_pops")).drop("_sum")


def _starts(rows: DataFrame) -> DataFrame:
    """_CHUNK and _start, the frames open before the chunk, of the chunks that start on a stack.

    Only depths are grouped with the rows; all else is a row a chunk and open frame.
    """
    last = F.struct("_n", "tick")
    levels = rows.groupBy(*_CHUNK, "_depth").agg(F.max(last).alias("_last"), F.max("_pops").alias("_pops"), F.max_by("frame", F.when(F.col("_step") == 1, last)).alias("frame"))
    effects = levels.groupBy(*_CHUNK).agg(F.max("_pops").alias("_pops"), F.max_by("_depth", "_last").alias("_end"), F.collect_list(F.struct("_depth", "frame")).alias("_levels"))
    w = Window.partitionBy(*_THREAD).orderBy("_chunk")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = effects.withColumn("_sum", F.sum(F.col("_end") - F.col("_pops")).over(so_far))
    low = F.least(F.lit(0), F.min(F.col("_sum") - F.col("_end")).over(so_far))  # after a chunk's pops
    after = summed.withColumn("_after", F.col("_sum") - low)
    placed = after.withColumn("_before", F.coalesce(F.lag("_after").over(w), F.lit(0))).withColumn("_base", F.col("_after") - F.col("_end"))
    pushed = placed.select(*_CHUNK, "_base", F.explode(F.filter("_levels", lambda x: (x["_depth"] > 0) & (x["_depth"] <= F.col("_end")))).alias("x"))
    pushed = pushed.select(*_CHUNK, (F.col("_base") + F.col("x._depth")).alias("_k"), F.col("x.frame").alias("frame"), F.lit(True).alias("_push"))
    asked = placed.filter("_before > 0").select(*_CHUNK, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_before"))).alias("_k"), F.lit(None).cast("string").alias("frame"), F.lit(False).alias("_push"))
    by_level = Window.partitionBy(*_THREAD, "_k").orderBy("_chunk", "_push").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = pushed.unionByName(asked).withColumn("_at", F.last("frame", ignorenulls=True).over(by_level)).filter(~F.col("_push"))
    return found.groupBy(*_CHUNK).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_at"))), lambda x: x["_at"]).alias("_start"))


def enters(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """trace_id, tid, ts, seq, tick, depth, frame, path_frames, path of each enter event.

    Without `chunk` a thread is one task, which is quickest where none is long. With it, a task has a chunk of a
    thread; it must not fall along the thread's order: floor(tick / 240), say.
    """
    return _of_threads(events) if chunk is None else _of_chunks(events, chunk)


def _of_threads(events: DataFrame) -> DataFrame:
    own = frame(F.col("routine_id"), F.col("call_site"))
    opened = with_depth(events).filter(F.col("kind") == ENTER).select(*_THREAD, *ORDER, "tick", "depth", own.alias("frame"))
    levels = opened.select("*", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("_k"))
    at = F.last(F.when(F.col("depth") == F.col("_k"), F.col("frame")), ignorenulls=True).over(_in_order("_k"))
    frames = levels.withColumn("_at", at).groupBy(*_THREAD, *ORDER, "tick", "depth", "frame")
    listed = frames.agg(F.sort_array(F.collect_list(F.struct("_k", "_at"))).alias("_f"))
    return listed.withColumn("path_frames", F.transform("_f", lambda x: x["_at"])).withColumn("path", F.array_join("path_frames", "/")).drop("_f")


def _of_chunks(events: DataFrame, chunk: Column) -> DataFrame:
    rows = _in_chunks(events, chunk)
    opened = rows.filter("_step = 1")
    levels = opened.select(*_CHUNK, "_n", "_depth", "frame", F.struct(*ORDER, "tick", "_pops").alias("_e"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_depth"))).alias("_k"))
    # the last enter at each level; only an event's own row, the one at its depth, carries its columns on
    at = F.last(F.when(F.col("_depth") == F.col("_k"), F.col("frame")), ignorenulls=True).over(Window.partitionBy(*_CHUNK, "_k").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.when(F.col("_depth") == F.col("_k"), F.col("_e"))
    each = levels.withColumn("_at", at).groupBy(*_CHUNK, "_n").agg(F.max(own).alias("_e"), F.sort_array(F.collect_list(F.struct("_k", "_at"))).alias("_f"))
    local = F.transform("_f", lambda x: x["_at"])
    joined = each.join(_starts(rows), _CHUNK, "left")
    kept = F.greatest(F.size("_start") - F.col("_e._pops"), F.lit(0)).cast("int")
    frames = F.when(F.col("_start").isNull(), local).otherwise(F.concat(F.slice("_start", F.lit(1), kept), local))
    found = joined.select(*_THREAD, *[F.col(f"_e.{c}").alias(c) for c in (*ORDER, "tick")], frames.alias("path_frames"))
    return found.select(*_THREAD, *ORDER, "tick", F.size("path_frames").alias("depth"), F.element_at("path_frames", -1).alias("frame"), "path_frames", F.array_join("path_frames", "/").alias("path"))


def per_thread(rows: DataFrame, start: Callable[[], Any], step: Callable[..., None], finish: Callable[[Any], list[tuple]], schema: str) -> DataFrame:
    """tid and what finish() gives of each thread's state, made by start() and changed by step(state, *values) for each row in order.

    rows: tid, ORDER, then the values. Sorted batches pass through, so a task holds one thread's state and no thread's rows.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    values = [c for c in rows.columns if c not in ("tid", *ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held = None, None, []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for tid, *row in zip(batch.column("tid").to_pylist(), *(batch.column(c).to_pylist() for c in values), strict=True):
                if state is None or tid != now:
                    held += [(now, *r) for r in finish(state)] if state is not None else []
                    now, state = tid, start()
                step(state, *row)
            if len(held) > HELD:
                yield batch_of()
                held = []
        held += [(now, *r) for r in finish(state)] if state is not None else []
        if held:
            yield batch_of()

    return rows.repartition("tid").sortWithinPartitions("tid", *ORDER).mapInArrow(run, kind)


def walk_stack(entered: DataFrame) -> DataFrame:
    """One row for each open frame of each enter: level, its frame and its path; what a stack walk visits."""
    each = entered.select("trace_id", "tid", *ORDER, F.posexplode("path_frames").alias("_i", "level_frame"), "path_frames")
    return each.select("trace_id", "tid", *ORDER, (F.col("_i") + 1).alias("level"), "level_frame", F.expr("array_join(slice(path_frames, 1, _i + 1), '/')").alias("level_path"))
