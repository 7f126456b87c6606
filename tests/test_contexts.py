"""Contexts, trees and sampling against plain state machines."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stackgrove.operators import contexts, sampling, trees
from stackgrove.params import BurstParams
from stackgrove.sources.events import SCHEMA


def frame_of(spark, rows):
    """rows: (tid, kind, routine, site, tick) in order."""
    start = datetime(2024, 1, 1)
    out = [("t", tid, i, kind, str(routine), site, start + timedelta(seconds=i), tick) for i, (tid, kind, routine, site, tick) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def random_rows(seed, n=400, threads=3, exits=0.45):
    r, tick, rows = random.Random(seed), 0, []
    for _ in range(n):
        tick += r.random() < 0.3
        kind = "EXIT" if r.random() < exits else "ENTER"
        rows.append((r.randrange(threads), kind, r.choice("abc"), r.randrange(2), tick))
    return rows


def machine(rows):
    """Of each enter, in order: tid, tick, path frames; and how many exits underflow."""
    stacks, out, under = {}, [], 0
    for tid, kind, routine, site, tick in rows:
        stack = stacks.setdefault(tid, [])
        if kind == "ENTER":
            stack.append(f"{routine}@{site}")
            out.append((tid, tick, list(stack)))
        elif stack:
            stack.pop()
        else:
            under += 1
    return out, under


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_equal_a_stack_machine(spark, seed):
    rows = random_rows(seed)
    want, under = machine(rows)
    df = frame_of(spark, rows)
    got = contexts.enters(df).orderBy("seq").collect()
    assert [list(r["path_frames"]) for r in got] == [f for _, _, f in want]
    assert contexts.underflow_exits(df).first()[0] == under
    for chunk in (F.lit(0), F.floor(F.col("seq") / 50), F.floor(F.col("seq") / 3), F.col("tick")):
        chunked = contexts.enters(df, chunk).orderBy("seq")
        assert chunked.collect() == got and chunked.columns == contexts.enters(df).columns
    tree = {r["path"]: r["counter"] for r in trees.exact_tree(contexts.enters(df)).collect()}
    assert tree == Counter("/".join(f) for _, _, f in want)


def test_one_long_thread_spreads_over_tasks(spark):
    rows = random_rows(5, n=600, threads=1, exits=0.3)
    df = frame_of(spark, rows)
    found = contexts.enters(df, F.floor(F.col("seq") / 40))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert [list(r["path_frames"]) for r in found.orderBy("seq").collect()] == [f for _, _, f in machine(rows)[0]]


def test_stack_walks(spark):
    rows = random_rows(6, n=80)
    walked = contexts.walk_stack(contexts.enters(frame_of(spark, rows))).collect()
    want = Counter("/".join(f[:k]) for _, _, f in machine(rows)[0] for k in range(1, len(f) + 1))
    assert Counter(r["level_path"] for r in walked) == want
    assert all(r["level_path"].split("/")[r["level"] - 1] == r["level_frame"] for r in walked)


def test_tick_clock_counts_earlier_ticks(spark):
    rows = [(1, "TICK", "", 0, 0), (1, "ENTER", "a", 0, 0), (2, "ENTER", "b", 0, 0), (1, "TICK", "", 0, 0), (1, "TICK", "", 0, 0), (1, "EXIT", "", 0, 0)]
    got = {(r["tid"], r["seq"]): r["tick_no"] for r in sampling.tick_clock(frame_of(spark, rows)).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 2): 0, (1, 3): 1, (1, 4): 2, (1, 5): 3}


def test_names_are_escaped(spark):
    df = frame_of(spark, [(1, "ENTER", "a/b@c%", 0, 0)])
    assert contexts.enters(df).first()["path"] == "a%2Fb%40c%25@0"


def burst_machine(rows, params):
    """Sampled paths and burst starts of each thread, by the tick-driven states."""
    sampled, starts = Counter(), []
    first = min(t for *_, t in rows if True)
    enters, _ = machine(rows)
    first = min(t for _, t, _ in enters)
    state = {}
    for tid, tick, frames in enters:
        t = tick - first
        seen, mode = state.get(tid, (0, "NO"))
        for now in range(seen, t):
            if now % params.interval == 0:
                mode = "MAYBE"
            if mode == "YES" and now % params.length == 0:
                mode = "NO"
        if mode == "MAYBE":
            mode = "YES"
            starts.append(frames)
            sampled["/".join(frames)] += 1
        elif mode == "YES":
            sampled["/".join(frames)] += 1
        state[tid] = (t, mode)
    return sampled, starts


@pytest.mark.parametrize(("seed", "interval", "length"), [(3, 10, 2), (4, 6, 1)])
def test_static_bursts_equal_the_state_machine(spark, seed, interval, length):
    rows, params = random_rows(seed), BurstParams(interval, length)
    sampled, starts = burst_machine(rows, params)
    found = sampling.static_bursts(sampling.relative_ticks(contexts.enters(frame_of(spark, rows))), params)
    assert Counter(r["path"] for r in found.collect()) == sampled
    walk = Counter(sampled)
    for frames in starts:
        walk.update("/".join(frames[:k]) for k in range(1, len(frames)))
    assert {r["path"]: r["counter"] for r in sampling.burst_tree(found, sampling.WALK).collect()} == walk
    with pytest.raises(ValueError):
        sampling.burst_tree(found, "other")


def test_a_clock_gate_starts_bursts_only_after_events_it_shut_out(spark):
    # a second a row; the gate is on in the last 2 of each 10
    other = lambda n: [(2, "EXIT", "", 0, 0)] * n
    rows = [(1, "ENTER", "a", 0, 0), *other(6), (1, "ENTER", "b", 0, 0), (1, "ENTER", "c", 0, 0), *other(9), (1, "ENTER", "d", 0, 0), (1, "EXIT", "", 0, 0), (1, "EXIT", "", 0, 0), *other(7), (1, "ENTER", "f", 0, 0)]
    found = sampling.wall_clock_bursts(frame_of(spark, rows), BurstParams(10 * 10**9, 2 * 10**9))
    got = [(r["seq"], r["path"], r["burst_start"]) for r in found.orderBy("seq").collect()]
    assert got == [(8, "a@0/b@0/c@0", True), (18, "a@0/b@0/c@0/d@0", False), (28, "a@0/b@0/f@0", True)]


def test_time_is_charged_to_the_stack_before_the_event(spark):
    rows = [(1, "ENTER", "a", 0, 0), (1, "ENTER", "b", 0, 3), (1, "EXIT", "x", 0, 7), (1, "EXIT", "x", 0, 9), (1, "ENTER", "c", 0, 14), (1, "EXIT", "x", 0, 15)]
    tree = {r["path"]: r["counter"] for r in sampling.time_tree(frame_of(spark, rows)).collect()}
    assert tree == {"a@0": 3 + 2, "a@0/b@0": 4, "c@0": 1}


def test_adaptive_bursts_start_on_new_contexts():
    rows = [(1, "a"), (2, "a/b"), (12, "a"), (13, "a"), (22, "a/c"), (23, "a/c")]
    never = sampling.adaptive_bursts(iter(rows), BurstParams(10, 1, re_enabling=0))
    assert never == {"a": 2, "a/c": 1}
    always = sampling.adaptive_bursts(iter(rows), BurstParams(10, 1, re_enabling=1))
    assert always["a"] == 3


def test_bad_parameters():
    for interval, length in ((5, 2), (1, 2), (5, 0)):
        with pytest.raises(ValueError):
            BurstParams(interval, length)


def test_empty_stream(spark):
    df = frame_of(spark, [])
    assert contexts.enters(df).count() == 0
    assert trees.tree_stats(trees.exact_tree(contexts.enters(df))).first().asDict() == {"nodes": 1, "sum_counters": 1, "hottest": 1}
