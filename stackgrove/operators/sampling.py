"""Burst sampling, its two counting policies, adaptive bursts, and time charged to contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import depth_of, prefixes
from ..params import BurstParams
from ..sources.events import ENTER, EXIT, ORDER, TICK
from .contexts import enters, per_thread, with_depth
from .trees import with_ancestors

_THREAD = ["trace_id", "tid"]
WALK, CREATE = "walk", "create"


def tick_clock(events: DataFrame) -> DataFrame:
    """Adds tick_no: the ticks before each event of its thread, from TICK events in the stream."""
    w = Window.partitionBy(*_THREAD).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("tick_no", F.coalesce(F.sum((F.col("kind") == TICK).cast("long")).over(w), F.lit(0)))


def relative_ticks(entered: DataFrame) -> DataFrame:
    """Adds tick_no from the column tick: ticks since the trace's first."""
    first = entered.groupBy("trace_id").agg(F.min("tick").alias("_first"))
    return entered.join(first, "trace_id").withColumn("tick_no", F.col("tick") - F.col("_first")).drop("_first")


def static_bursts(entered: DataFrame, params: BurstParams) -> DataFrame:
    """The sampled enters (with tick_no), and burst_start of the first in each cycle.

    A cycle is `interval` ticks. From its first enter, at tick m, all enters up to the next multiple
    of `length` are sampled; none before the first tick.
    """
    t, s, b = F.col("tick_no"), params.interval, params.length
    cycle = F.floor((t - 1) / s)
    w = Window.partitionBy(*_THREAD, "cycle")
    rows = entered.filter(t > 0).withColumn("cycle", cycle).withColumn("_m", F.min("tick_no").over(w))
    kept = rows.withColumn("burst_start", F.row_number().over(w.orderBy(*ORDER)) == 1).filter(t <= F.ceil(F.col("_m") / b) * b)
    return kept.drop("_m")


def wall_clock_bursts(events: DataFrame, params: BurstParams) -> DataFrame:
    """Sampled enters of a gate that is off first and on for the last `length` nanoseconds of each interval, from the trace's first enter on.

    burst_start: the first sampled enter after an event of its thread that the gate shut out. An off-phase without
    events, like a thread's beginning, leaves the stack aligned, so the enter after it starts no burst.
    """
    first = F.broadcast(events.filter(F.col("kind") == ENTER).groupBy(F.col("trace_id").alias("_trace")).agg(F.min("ts").alias("_first")))  # a row a trace
    entered = enters(events).withColumn("_enter", F.lit(True))
    both = entered.unionByName(events.filter(F.col("kind") == EXIT).select(*_THREAD, *ORDER, F.lit(False).alias("_enter")), allowMissingColumns=True)
    both = both.join(first, F.col("trace_id") == F.col("_trace"))
    elapsed = (F.unix_micros("ts") - F.unix_micros("_first")) * 1000
    timed = both.withColumn("cycle", F.floor(elapsed / params.interval)).withColumn("_on", elapsed % params.interval >= params.interval - params.length)
    w = Window.partitionBy(*_THREAD).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    aligned = F.last(F.when(~F.col("_on"), False).when(F.col("_enter"), True), ignorenulls=True).over(w)
    rows = timed.withColumn("burst_start", ~F.coalesce(aligned, F.lit(True))).filter(F.col("_on") & F.col("_enter"))
    return rows.drop("_enter", "_on", "_trace", "_first")


def burst_tree(sampled: DataFrame, policy: str = WALK) -> DataFrame:
    """path, depth, counter of sampled enters, with what aligning the stack at each burst start adds.

    walk: each open frame counts once more. create: an ancestor counts once where a burst starts
    below it in its thread before it is itself entered while sampling.
    """
    own = sampled.select("tid", "path", F.lit(1).cast("long").alias("counter"), F.struct(*ORDER).alias("at"), F.lit(True).alias("entered"))
    start = sampled.filter("burst_start").select("tid", "path", F.struct(*ORDER).alias("at"))
    above = start.select("tid", F.explode(prefixes(F.col("path"))).alias("path"), "at", F.col("path").alias("_own")).filter("path <> _own")
    if policy == WALK:
        both = own.select("path", "counter").unionByName(above.select("path", F.lit(1).cast("long").alias("counter")))
        sums = both.groupBy("path").agg(F.sum("counter").alias("counter"))
    elif policy == CREATE:
        both = own.unionByName(above.select("tid", "path", F.lit(0).cast("long").alias("counter"), "at", F.lit(False).alias("entered")))
        each = both.groupBy("tid", "path").agg(F.sum("counter").alias("counter"), F.min(F.when(F.col("entered"), F.col("at"))).alias("_in"), F.min(F.when(~F.col("entered"), F.col("at"))).alias("_up"))
        extra = F.when(F.col("_up").isNotNull() & (F.col("_in").isNull() | (F.col("_up") < F.col("_in"))), 1).otherwise(0)
        sums = each.withColumn("counter", F.col("counter") + extra).groupBy("path").agg(F.sum("counter").alias("counter"))
    else:
        raise ValueError(f"policy must be {WALK} or {CREATE}")
    return sums.select("path", depth_of(F.col("path")).alias("depth"), "counter")


def burst_stats(entered: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: enters, sampled enters, bursts, and sampled ones in percent."""
    n = entered.agg(F.count("*").alias("enters"))
    k = sampled.agg(F.count("*").alias("sampled"), F.sum(F.col("burst_start").cast("long")).alias("bursts"))
    return n.crossJoin(k).select("enters", "sampled", "bursts", (F.col("sampled") * 100 / F.col("enters")).alias("percent"))


def burst_report(entered: DataFrame, sampled: DataFrame, params: BurstParams, tick_us: int) -> DataFrame:
    """burst_stats(), and in microseconds the sampling interval, the burst and the time from the first tick to the last."""
    span = entered.agg(F.coalesce((F.max("tick") - F.min("tick")) * tick_us, F.lit(0)).cast("long").alias("run_us"))
    timed = burst_stats(entered, sampled).crossJoin(span)  # one row each
    return timed.withColumns({"sampling_us": F.lit(params.interval * tick_us).cast("long"), "burst_us": F.lit(params.length * tick_us).cast("long")})


def reenabled(seed: int, burst: int, rate: int) -> bool:
    """One in `rate` bursts on known contexts, by a hash of the seed and the burst's number."""
    return rate > 0 and int.from_bytes(hashlib.blake2b(f"{seed}:{burst}".encode(), digest_size=8).digest(), "big") % rate == 0


class AdaptiveBursts:
    """Counters of one thread's enters: a new context always starts its burst, a known one by chance.

    A burst that is not started leaves all counters as they are. compensate: enters of a burst on a
    known context weigh as many as bursts of its kind are let through.
    """

    def __init__(self, params: BurstParams, compensate: bool = False):
        self.params, self.compensate = params, compensate
        self.counters: dict[str, int] = {}
        self.on, self.due, self.weight, self.end, self.cycle, self.tried = False, False, 1, 0, -1, 0

    def enter(self, tick: int, path: str) -> None:
        if tick <= 0:
            return
        now = (tick - 1) // self.params.interval
        if now != self.cycle:
            self.cycle, self.due, self.on = now, True, self.on and tick <= self.end
        if self.on and tick > self.end:
            self.on = False
        if self.due:
            self.due = False
            self.tried += 1
            known = path in self.counters
            self.on = not known or reenabled(self.params.seed, self.tried, self.params.re_enabling)
            if self.on:
                self.weight = self.params.re_enabling if known and self.compensate else 1
                self.end = -(-tick // self.params.length) * self.params.length
                parts = path.split("/")
                for k in range(1, len(parts)):
                    self._count("/".join(parts[:k]))
        if self.on:
            self._count(path)

    def _count(self, path: str) -> None:
        self.counters[path] = self.counters.get(path, 0) + self.weight


def adaptive_bursts(rows: Iterator[tuple[int, str]], params: BurstParams, compensate: bool = False) -> dict[str, int]:
    """The counters of one thread's enters (tick_no, path)."""
    state = AdaptiveBursts(params, compensate)
    for tick, path in rows:
        state.enter(tick, path)
    return state.counters


def adaptive_tree(entered: DataFrame, params: BurstParams, compensate: bool = False) -> DataFrame:
    """tid, path, counter of adaptive bursts; what is sampled depends on the thread's tree so far, so a thread is a task."""
    rows = entered.select("tid", *ORDER, "tick_no", "path")
    return per_thread(rows, lambda: AdaptiveBursts(params, compensate), lambda state, tick, path: state.enter(tick, path), lambda state: list(state.counters.items()), "tid long, path string, counter long")


def time_charges(events: DataFrame) -> DataFrame:
    """tid, path, elapsed: ticks since each thread's last event, charged to the stack before the event.

    The frame open at depth d is the last one entered there; an empty stack charges the root, ''.
    """
    thread = Window.partitionBy(*_THREAD).orderBy(*ORDER)
    rows = with_depth(events).withColumn("_level", F.lag("depth").over(thread)).withColumn("elapsed", F.col("tick") - F.lag("tick").over(thread))
    opened = enters(events).select(*_THREAD, *ORDER, F.col("depth").alias("_level"), "path", F.lit(None).cast("long").alias("elapsed"))
    asked = rows.filter("_level is not null").select(*_THREAD, *ORDER, "_level", F.lit(None).cast("string").alias("path"), "elapsed")
    # an enter opens its frame for later events only
    w = Window.partitionBy(*_THREAD, "_level").orderBy(*ORDER, F.col("elapsed").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = opened.unionByName(asked).withColumn("_open", F.last("path", ignorenulls=True).over(w))
    return both.filter("elapsed is not null").select("tid", F.when(F.col("_level") == 0, "").otherwise(F.col("_open")).alias("path"), "elapsed")


def time_tree(events: DataFrame) -> DataFrame:
    """path, depth, counter in ticks, ancestors with 0 included; the root's own ticks are left out."""
    charged = time_charges(events).filter("path <> ''").groupBy("path").agg(F.sum("elapsed").alias("counter"))
    return with_ancestors(charged)
