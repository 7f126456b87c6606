"""Guarantees of the sketches, and their trees."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackgrove.operators.sketches import ENGINES, SCHEMA, BucketSpaceSaving, LossyCounting, SpaceSaving, hot_trees
from stackgrove.params import SketchParams, choose_phi, pool_bytes, table_size, trace_thresholds

PATHS = ["a", "a/b", "a/b/c", "a/d", "e", "e/f", "e/f/g", "h", "h/i", "j"]
streams = st.lists(st.sampled_from(PATHS), max_size=300)


@settings(max_examples=60, deadline=None)
@given(streams, st.integers(2, 12))
@pytest.mark.parametrize("engine", [SpaceSaving, BucketSpaceSaving])
def test_space_saving_bounds(engine, stream, size):
    sketch, true = engine(size), Counter(stream)
    for path in stream:
        sketch.enter(path)
    n = len(stream) + 1
    assert len(sketch.count) <= size
    for path, count in sketch.count.items():
        if path:
            assert true[path] <= count <= true[path] + n / size + 1
            assert count - sketch.over[path] <= true[path]
    for path, count in true.items():
        if count > n / size:
            assert path in sketch.count
    known = set(sketch.tree.children)
    assert all(p.rpartition("/")[0] in known for p in known if p)
    if size > len(PATHS) + 1:
        assert {p: c for p, c, *_ in sketch.rows()} == {p: true[p] for p in known if p}


@settings(max_examples=60, deadline=None)
@given(streams, st.integers(1, 40))
def test_lossy_counting_bounds(stream, width):
    sketch, true = LossyCounting(width), Counter(stream)
    for path in stream:
        sketch.enter(path)
    for path in sketch.monitored:
        assert sketch.count[path] <= true[path] <= sketch.count[path] + sketch.delta[path] + len(stream) / width + 1
    for path, count in true.items():
        if count > len(stream) / width + 1:
            assert path in sketch.monitored


def test_a_true_minimum_is_evicted():
    sketch = SpaceSaving(4)
    for path, n in (("a", 5), ("b", 3), ("c", 2)):
        for _ in range(n):
            sketch.enter(path)
    for new in ("d", "e", "f"):
        sketch.enter(new)
    assert sketch.count["a"] == 5
    assert sum(sketch.count.values()) == 14


class PlainNode:
    def __init__(self, frame, parent):
        self.frame, self.parent, self.children = frame, parent, []
        self.counter = self.eps = self.delta = 0
        self.monitored = False

    def path(self):
        return "" if self.parent is None else f"{self.parent.path()}/{self.frame}".lstrip("/")


class PlainSketch:
    """A tree of nodes and a list of monitored ones, searched from the front: what the engines must equal, row by row."""

    def __init__(self, engine, size):
        self.engine, self.size = engine, size
        self.root = PlainNode("", None)
        self.root.monitored, self.root.counter = True, 0 if engine == "bss" else 1
        self.table = [] if engine == "lc" else [self.root]
        self.stamp = {id(self.root): 0}  # when an item came to its count, for buckets
        self.clock, self.index, self.bucket = 0, 1, 0

    def find(self, path):
        node = self.root
        for frame in path.split("/"):
            child = next((c for c in node.children if c.frame == frame), None)
            if child is None:
                child = PlainNode(frame, node)
                node.children.append(child)
                child.delta, child.fresh = self.bucket, True
            node = child
        return node

    def prune(self, node, current):
        on_stack = set()
        while current is not None:
            on_stack.add(id(current))
            current = current.parent
        while node.parent is not None and not node.children and not node.monitored and id(node) not in on_stack:
            node.parent.children.remove(node)
            node = node.parent

    def enter(self, path, weight=1):
        node = self.find(path)
        if self.engine == "lc":
            self.index += weight
            if weight:
                if not node.monitored:
                    node.monitored = True
                    self.table.append(node)
                    if not node.counter:
                        node.delta = self.bucket
                node.counter += weight
            while self.index >= self.size:
                for old in [x for x in self.table if x is not node and x.counter + x.delta <= self.bucket + 1]:
                    self.table.remove(old)
                    old.monitored = False
                    self.prune(old, node)
                self.index, self.bucket = self.index - self.size, self.bucket + 1
            return
        if not weight:
            return
        self.clock += 1
        if node.monitored:
            node.counter += weight
        else:
            low, at = 0, len(self.table)
            if at == self.size:
                least = min(x.counter for x in self.table)
                least_ones = [i for i, x in enumerate(self.table) if x.counter == least]
                at = min(least_ones, key=lambda i: self.stamp[id(self.table[i])]) if self.engine == "bss" else least_ones[0]
                old = self.table[at]
                low, old.monitored = old.counter, False
                self.table[at] = node
                node.monitored = True
                self.prune(old, node)
            else:
                self.table.append(node)
                node.monitored = True
            node.counter, node.eps = low + weight, low
        self.stamp[id(node)] = self.clock

    def rows(self):
        out, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            todo += node.children
            if node.parent is not None:
                known = node.monitored or self.engine == "lc"
                out.add((node.path(), node.counter if known else 0, node.monitored, node.eps if node.monitored else 0, node.delta if self.engine == "lc" and node.counter else 0))
        return out


weighted = st.lists(st.tuples(st.sampled_from(PATHS), st.integers(0, 3)), max_size=200)


@settings(max_examples=150, deadline=None)
@given(weighted, st.integers(2, 7), st.booleans())
@pytest.mark.parametrize("name", ["lss", "bss", "lc"])
def test_engines_equal_a_plain_reading(name, stream, size, plain):
    sketch, want = ENGINES[name](size), PlainSketch(name, size)
    for path, weight in stream:
        weight = 1 if plain else weight
        sketch.enter(path, weight)
        want.enter(path, weight)
    assert set(sketch.rows()) == want.rows()


def test_the_first_window_counts_the_root():
    sketch = LossyCounting(4)
    for path in ("a", "b", "a"):
        sketch.enter(path)
    assert sketch.bucket == 1 and sketch.monitored == {"a"}


def test_hot_trees_of_sketches(spark):
    threads = spark.createDataFrame([(1, "a", 0, False, 0, 0), (1, "a/b", 3, True, 1, 0), (1, "c", 1, True, 0, 2), (1, "d", 2, True, 0, 0), (2, "a/b", 9, True, 0, 0), (2, "a", 1, False, 0, 0)], SCHEMA)
    entered = spark.createDataFrame([(1,)] * 30 + [(2,)] * 95, "tid long")
    got = {(r["tid"], r["path"]): r["hot"] for r in hot_trees(threads, entered, 10).collect()}
    assert got == {(1, "a"): False, (1, "a/b"): True, (1, "c"): True, (2, "a"): False, (2, "a/b"): True}


def test_weight_zero_is_cold():
    sketch = SpaceSaving(4)
    sketch.enter("a/b", 0)
    assert {(p, m) for p, _, m, *_ in sketch.rows()} == {("a", False), ("a/b", False)}


def test_scalar_rules():
    assert table_size(0.3) == 4 and table_size(5) == 50000
    assert choose_phi(2) == 1e-4 and choose_phi(0, 0.01) == 0.05 and choose_phi(0.2, 0.01) == 0.2
    assert trace_thresholds(1000, 10, 50) == (100, 100) and trace_thresholds(1000, 10, 50, "lc") == (100, 80)
    assert pool_bytes(1025) == 12 + 2 * (4 + 1024 * 20)
    with pytest.raises(ValueError):
        SketchParams(epsilon=0.1, phi=0.01)
