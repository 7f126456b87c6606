"""Frequent contexts in bounded memory: Space Saving (lazy minimum or buckets) and Lossy Counting.

Each sketch holds a tree: the monitored contexts, and their ancestors kept cold. Batch form: a
thread's enters in order, as sorted batches, so a task holds one sketch at a time. Across threads and for threads too long for a task
there is `approximate_top`, whose partial sketches merge.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.events import ORDER
from .contexts import per_thread
from .trees import hot_tree


class _Tree:
    """Known paths with their number of children; unmonitored childless paths go, up to one that is open or needed."""

    def __init__(self) -> None:
        self.children: dict[str, int] = {"": 0}

    def add(self, path: str) -> None:
        new = []
        while path not in self.children:
            new.append(path)
            path = path.rpartition("/")[0]
        for p in reversed(new):
            self.children[p.rpartition("/")[0]] += 1
            self.children[p] = 0

    def drop(self, path: str, monitored: Iterable[str], open_path: str) -> None:
        while path and path in self.children and not self.children[path] and path not in monitored and not (open_path + "/").startswith(path + "/"):
            del self.children[path]
            path = path.rpartition("/")[0]
            self.children[path] -= 1


class SpaceSaving:
    """Lazy Space Saving over a table of `size` items, one of them the root.

    A new item takes the place of a minimum one (of several, the oldest place) and starts from its
    count, which is also the most it can be over by.
    """

    def __init__(self, size: int):
        if size < 2:
            raise ValueError("a table needs two items or more")
        self.size = size
        self.count: dict[str, int] = {"": 1}
        self.over: dict[str, int] = {"": 0}
        self.place: dict[str, int] = {"": 0}
        self.heap: list[tuple[int, int, str]] = [(1, 0, "")]
        self.tree = _Tree()

    def _evict(self, open_path: str) -> tuple[int, int]:
        while True:
            n, place, path = self.heap[0]
            now = self.count.get(path)
            if now is None or self.place[path] != place:
                heapq.heappop(self.heap)
            elif now != n:
                heapq.heapreplace(self.heap, (now, place, path))
            else:
                heapq.heappop(self.heap)
                del self.count[path], self.over[path], self.place[path]
                self.tree.drop(path, self.count, open_path)
                return n, place

    def enter(self, path: str, weight: int = 1) -> None:
        """Counts a context; a weight of 0 only makes it known."""
        if path in self.count:
            self.count[path] += weight
            return
        self.tree.add(path)
        if not weight:
            return
        low, place = (0, len(self.count)) if len(self.count) < self.size else self._evict(path)
        self.count[path], self.over[path], self.place[path] = low + weight, low, place
        heapq.heappush(self.heap, (low + weight, place, path))

    def rows(self) -> list[tuple[str, int, bool, int, int]]:
        """path, counter, monitored, eps, delta of all paths in the tree but the root."""
        return [(p, self.count.get(p, 0), p in self.count, self.over.get(p, 0), 0) for p in self.tree.children if p]


class BucketSpaceSaving(SpaceSaving):
    """The same with items in buckets of equal count, so that a minimum is found at once; the root starts at 0."""

    def __init__(self, size: int):
        super().__init__(size)
        self.count[""] = 0
        self.buckets: dict[int, OrderedDict[str, None]] = {0: OrderedDict({"": None})}
        self.least = 0

    def _move(self, path: str, old: int | None, new: int) -> None:
        if old is not None:
            del self.buckets[old][path]
            if not self.buckets[old]:
                del self.buckets[old]
        self.buckets.setdefault(new, OrderedDict())[path] = None
        if new < self.least or self.least not in self.buckets:
            self.least = min(self.buckets)

    def _evict(self, open_path: str) -> tuple[int, int]:
        n = self.least
        path = next(iter(self.buckets[n]))
        del self.buckets[n][path]
        if not self.buckets[n]:
            del self.buckets[n]
        place = self.place[path]
        del self.count[path], self.over[path], self.place[path]
        self.tree.drop(path, self.count, open_path)
        return n, place

    def enter(self, path: str, weight: int = 1) -> None:
        if path in self.count:
            old = self.count[path]
            self.count[path] = old + weight
            if weight:
                self._move(path, old, old + weight)
            return
        self.tree.add(path)
        if weight:
            low, place = (0, len(self.count)) if len(self.count) < self.size else self._evict(path)
            self.count[path], self.over[path], self.place[path] = low + weight, low, place
            self._move(path, None, low + weight)


class LossyCounting:
    """Lossy Counting over windows of `width` enters; an item has its count and the most it can be under by.

    A context that is known but cold keeps both when it is monitored again.
    """

    def __init__(self, width: int):
        if width < 1:
            raise ValueError("a window needs an enter")
        self.width, self.bucket, self.index = width, 0, 1  # the root is the first of the stream
        self.count: dict[str, int] = {}
        self.delta: dict[str, int] = {}
        self.monitored: set[str] = set()
        self.tree = _Tree()

    def enter(self, path: str, weight: int = 1) -> None:
        self.index += weight
        if path not in self.tree.children:
            self.tree.add(path)
        if weight:
            if path not in self.count:
                self.count[path], self.delta[path] = 0, self.bucket
            self.monitored.add(path)
            self.count[path] += weight
        while self.index >= self.width:
            self._close(path)

    def _close(self, open_path: str) -> None:
        gone = [p for p in self.monitored if p != open_path and self.count[p] + self.delta[p] <= self.bucket + 1]
        self.monitored.difference_update(gone)
        for p in sorted(gone, key=len, reverse=True):
            self.tree.drop(p, self.monitored, open_path)
        for p in [p for p in self.count if p not in self.tree.children]:
            del self.count[p], self.delta[p]
        self.index -= self.width
        self.bucket += 1

    def rows(self) -> list[tuple[str, int, bool, int, int]]:
        return [(p, self.count.get(p, 0), p in self.monitored, 0, self.delta.get(p, 0)) for p in self.tree.children if p]


ENGINES = {"lss": SpaceSaving, "bss": BucketSpaceSaving, "lc": LossyCounting}
SCHEMA = "tid long, path string, counter long, monitored boolean, eps long, delta long"


def sketch(entered: DataFrame, engine: str, size: int, weight: Column | None = None) -> DataFrame:
    """tid, path, counter, monitored, eps, delta of each thread's sketch; size is the table's or the window's."""
    make = ENGINES[engine]
    rows = entered.select("tid", *ORDER, "path", (F.lit(1) if weight is None else weight).cast("long").alias("weight"))
    return per_thread(rows, lambda: make(size), lambda state, path, w: state.enter(path, w), lambda state: state.rows(), SCHEMA)


def hot_trees(threads: DataFrame, entered: DataFrame, phi: int, weight: Column | None = None) -> DataFrame:
    """The hot tree of each thread's sketch: monitored contexts whose counter and delta reach its enters by phi, and their ancestors.

    phi is a reciprocal. A thread's stream is its enters (or their weights) alone.
    """
    total = entered.groupBy("tid").agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("_n"))
    found = hot_tree(threads.join(total, "tid"), F.floor(F.col("_n") / phi), inclusive=True, delta=True, by=["tid"])
    return found.select("tid", "path", "counter", "monitored", "eps", "delta", "hot")


def merged_sketch(threads: DataFrame) -> DataFrame:
    """One tree of all threads' sketches: counters, errors and deltas add up, monitored anywhere is monitored."""
    return threads.groupBy("path").agg(F.sum("counter").alias("counter"), F.max("monitored").alias("monitored"), F.sum("eps").alias("eps"), F.sum("delta").alias("delta"))


def approximate_top(entered: DataFrame, k: int, size: int) -> DataFrame:
    """path and estimate of the k most entered contexts, from sketches of `size` items made where the rows are and merged."""
    found = entered.agg(F.expr(f"approx_top_k(path, {int(k)}, {int(size)})").alias("top"))
    return found.select(F.explode("top").alias("x")).select(F.col("x.item").alias("path"), F.col("x.count").alias("counter"))
