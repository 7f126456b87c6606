"""The three offline requests over tree dumps: summary of one, comparison of two, symbols of one."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DUMMY
from ..operators import matching, metrics, symbols, trees
from ..params import choose_phi, min_threshold, pool_bytes
from ..sources import dumps

FULL, QUICK = "full", "quick"


def load(spark: SparkSession, path: str, dialect: str = "v2") -> tuple[DataFrame, dict]:
    """Nodes with paths, and the run's row as a dict; a dump that doesn't hold together raises BadDump."""
    raw, runs = dumps.read_dumps(spark, path), dumps.read_runs(spark, path, dialect)
    problem = dumps.checked(raw, runs).first()
    if problem:
        raise dumps.BadDump(f"{problem['run_id']}: {problem['problem']}")
    found = runs.limit(2).collect()
    if len(found) != 1:
        raise dumps.BadDump(f"{path} should hold one dump")
    return dumps.with_paths(raw), found[0].asDict()


def is_sketch(run: dict) -> bool:
    return run["tool"].startswith("lss")


def measure(run: dict) -> int:
    """What phi is a part of: sampled enters of bursts, ticks of timed trees, else all enters."""
    if run["tool"].endswith("-time"):
        return run["thread_tics"]
    return run["events"]


def hot_threshold(run: dict, phi: float) -> int:
    return min_threshold(choose_phi(phi, run["epsilon"] if is_sketch(run) else None), measure(run))


def adjust_factor(first: dict, second: dict) -> float:
    """Events of the first by those of the second; 1 for timed trees."""
    if first["tool"].endswith("-time") or second["tool"].endswith("-time"):
        return 1.0
    return measure(first) / measure(second)


def analyse(spark: SparkSession, path: str, phi: float = 0.0, dialect: str = "v2") -> tuple[DataFrame, DataFrame]:
    """One summary row, and the tree (of a sketch the hot part)."""
    nodes, run = load(spark, path, dialect)
    threshold = hot_threshold(run, phi)
    if is_sketch(run):
        nodes = trees.hot_tree(nodes, threshold)
    hot = nodes.agg(F.sum((F.col("counter") > threshold).cast("long")).alias("hot_nodes"))
    near = trees.near_hottest(nodes, [10]).select(F.col("nodes").alias("near_hottest"))
    row = trees.tree_stats(nodes).crossJoin(hot).crossJoin(near).crossJoin(trees.distinct_routines(nodes))  # one row each
    page = pool_bytes(1, is_sketch(run)) - pool_bytes(0)
    return row.withColumn("bytes", F.lit(pool_bytes(0)) + F.ceil(F.col("nodes") / 1024) * page).withColumns({"stream": F.lit(measure(run)), "phi": F.lit(phi), "threshold": F.lit(threshold)}), nodes


def compare(spark: SparkSession, first_path: str, second_path: str, first_symbols: DataFrame | None = None, second_symbols: DataFrame | None = None, phi: float = 0.0, mode: str = FULL) -> dict[str, DataFrame]:
    """Tables by name: matches, summary, accuracy, partition; full adds uncovered and coverage.

    full: subtree weights are of the unpruned trees and only a sketch is pruned; quick: both are
    pruned first, and more children are assigned exactly.
    """
    if mode not in (FULL, QUICK):
        raise ValueError(f"mode must be {FULL} or {QUICK}")
    (first, one), (second, two) = load(spark, first_path), load(spark, second_path)
    low, high = hot_threshold(one, phi), hot_threshold(two, phi)
    adjust = adjust_factor(one, two)
    named = [None if s is None else s.withColumn("address", F.lower(F.hex("address"))) for s in (first_symbols, second_symbols)]
    if mode == QUICK:
        first, second = trees.hot_tree(first, low), trees.hot_tree(second, high)
    left, right = matching.described(first, named[0]), matching.described(second, named[1])
    if mode == FULL and is_sketch(two):
        right = right.join(trees.hot_tree(second, high).select("path"), "path", "left_semi")
    matches = matching.match_trees(left, right, adjust, matching.EXACT_FULL if mode == FULL else matching.EXACT_QUICK)
    bound = int(two["epsilon"] * measure(one)) if two["tool"] == "lss-hcct" else None
    out = {
        "matches": matches,
        "summary": matching.match_summary(matches, right),
        "accuracy": metrics.counter_accuracy(left, right, matches, low, adjust, bound),
        "partition": metrics.node_partition(left, right, matches, low, high),
    }
    if mode == FULL:
        out["uncovered"] = matching.unmatched_frequency(left, matches)
        out["coverage"] = metrics.factor_coverage(left, matches.filter("second_path is not null").select(F.col("first_path").alias("path")), low)
    return out


def run_report(df: DataFrame, events: int) -> DataFrame:
    """Runs a query into a sink that drops its rows; one row: its seconds, microseconds an event, and the driver JVM's peak heap in KB."""
    spark = df.sparkSession
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    peak = sum(p.getPeakUsage().getUsed() for p in pools if str(p.getType()) == "Heap memory") // 1024
    return spark.createDataFrame([(seconds, seconds * 1e6 / events if events else None, events, peak)], "seconds double, us_per_event double, events long, peak_kb long")


def solve(spark: SparkSession, path: str, maps_path: str, table: DataFrame, resolver: symbols.Resolver | None = None) -> DataFrame:
    """address, name, file, image, offset of all routines and call sites of a dump, and the dummy symbol of address 0.

    table has the known symbols by address; a resolver is asked for the others that lie in a region.
    """
    nodes, _ = load(spark, path)
    wanted = nodes.select(F.explode(F.array("routine_id", "call_site")).alias("address")).filter("address <> 0").distinct()
    regions = dumps.read_maps(spark, maps_path)
    if resolver is not None:
        known = table.select("address", "name", "file")
        table = known.unionByName(symbols.asked(symbols.in_regions(wanted.join(known, "address", "left_anti"), regions), resolver))
    found = symbols.resolve(wanted, regions, table)
    dummy = spark.createDataFrame([(0, DUMMY, DUMMY, DUMMY, 0)], "address long, name string, file string, image string, offset long")
    return found.unionByName(dummy)
