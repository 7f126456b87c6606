"""Named queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import depth_of
from ..operators import contexts, matching, metrics, sampling, sketches, symbols, trees
from ..params import BurstParams, pool_bytes
from ..scratch import Scratch
from ..sinks import texts
from ..sources import dumps, traces
from ..sources.events import ENTER, read_event_log

#: Reciprocal of the hot fraction, ticks of a sampling cycle and burst, and reciprocal of tau in these queries.
PHI, BURST, TAU = 1000, BurstParams(24, 6), 10
#: Sketch sizes below and above the number of contexts of a thread.
SMALL, LARGE = 16, 1 << 20
#: Reciprocal of the hot fraction of a thread's sketch.
SKETCH_PHI = 10
Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_event_log(spark, sf_dir)


def _enters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.enters(_events(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.exact_tree(_enters(spark, sf_dir))


def _n(spark: SparkSession, sf_dir: str) -> int:
    """Enters of the whole stream: a count that reads one column."""
    return _events(spark, sf_dir).filter(F.col("kind") == ENTER).count()


def _threshold(spark: SparkSession, sf_dir: str) -> int:
    return _n(spark, sf_dir) // PHI


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.static_bursts(sampling.relative_ticks(_enters(spark, sf_dir)), BURST)


def _burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.burst_tree(_sampled(spark, sf_dir), sampling.WALK)


def _adjust(spark: SparkSession, sf_dir: str) -> float:
    """Enters of the exact tree by those of the sampled one."""
    total = _burst(spark, sf_dir).agg(F.sum("counter")).first()[0]
    return _n(spark, sf_dir) / total if total else 1.0


def _same_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each sampled node with the exact node of its path."""
    return _burst(spark, sf_dir).select(F.col("path").alias("first_path"), F.col("path").alias("second_path"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def exact_cct(spark, sf_dir):
    return _tree(spark, sf_dir)


def cct_by_thread(spark, sf_dir):
    return trees.exact_tree(_enters(spark, sf_dir), by_thread=True)


def merge_threads(spark, sf_dir):
    return trees.merge_threads(cct_by_thread(spark, sf_dir))


def underflow_exits(spark, sf_dir):
    return contexts.underflow_exits(_events(spark, sf_dir))


def chunked_cct(spark, sf_dir):
    """The exact tree from threads cut at each day, so that a task never has more of one than that."""
    return trees.exact_tree(contexts.enters(_events(spark, sf_dir), F.floor(F.col("tick") / 24)))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tree with the column threshold, from a count of enters that is one row."""
    limit = _events(spark, sf_dir).filter(F.col("kind") == ENTER).agg(F.floor(F.count("*") / PHI).alias("threshold"))
    return _tree(spark, sf_dir).crossJoin(F.broadcast(limit))


def hot_strict(spark, sf_dir):
    return trees.hot_nodes(_marked(spark, sf_dir), F.col("threshold")).select("path", "counter")


def hot_inclusive(spark, sf_dir):
    return trees.hot_nodes(_marked(spark, sf_dir), F.col("threshold"), inclusive=True).select("path", "counter")


def hcct_offline(spark, sf_dir):
    return trees.hot_tree(_marked(spark, sf_dir), F.col("threshold")).drop("threshold")


def hcct_trace(spark, sf_dir):
    return trees.hot_tree(_marked(spark, sf_dir), F.col("threshold"), inclusive=True).drop("threshold")


def prune_depth(spark, sf_dir):
    return trees.prune_depth(_tree(spark, sf_dir), 3)


def tree_stats(spark, sf_dir):
    return trees.tree_stats(_tree(spark, sf_dir))


def subtree_sums(spark, sf_dir):
    return trees.subtree_sums(_tree(spark, sf_dir)).select("path", "inclusive")


def subtree_weights(spark, sf_dir):
    return trees.subtree_sums(_tree(spark, sf_dir)).select("path", "exclusive")


def degree_stats(spark, sf_dir):
    return _rounded(trees.degrees(_tree(spark, sf_dir)), "avg_degree")


def distinct_routines(spark, sf_dir):
    return trees.distinct_routines(_tree(spark, sf_dir))


def distinct_routines_trace(spark, sf_dir):
    return trees.distinct_routines(_tree(spark, sf_dir), with_root=True)


def tau_count(spark, sf_dir):
    return trees.near_hottest(_tree(spark, sf_dir), [TAU])


def max_phi_table(spark, sf_dir):
    return _rounded(trees.max_phi_table(_tree(spark, sf_dir)), "overlap")


def hot_per_phi(spark, sf_dir):
    return trees.hot_per_phi(_tree(spark, sf_dir), [100, 1000, 5000])


def sibling_rank(spark, sf_dir):
    return trees.sibling_rank(_tree(spark, sf_dir))


def growth_curve(spark, sf_dir):
    return trees.growth_curve(_enters(spark, sf_dir))


def growth_log(spark, sf_dir):
    return trees.growth_log(_enters(spark, sf_dir), 100)


def static_burst_walk(spark, sf_dir):
    return _burst(spark, sf_dir).select("path", "counter")


def static_burst_create(spark, sf_dir):
    return sampling.burst_tree(_sampled(spark, sf_dir), sampling.CREATE).select("path", "counter")


def burst_stats(spark, sf_dir):
    return _rounded(sampling.burst_stats(_enters(spark, sf_dir), _sampled(spark, sf_dir)), "percent")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400 * 10**9
    return sampling.wall_clock_bursts(_events(spark, sf_dir), BurstParams(day, day // 4))


def wall_clock_bursts(spark, sf_dir):
    """Sampled enters of each context under a clock's gate, and bursts that start there."""
    return _gated(spark, sf_dir).groupBy("path").agg(F.count("*").alias("counter"), F.sum(F.col("burst_start").cast("long")).alias("bursts"))


def wall_clock_tree(spark, sf_dir):
    """The aligned tree of those bursts; ancestors count where they must be created."""
    return sampling.burst_tree(_gated(spark, sf_dir), sampling.CREATE).select("path", "counter")


def elapsed_ticks(spark, sf_dir):
    return sampling.time_charges(_events(spark, sf_dir)).groupBy("tid").agg(F.sum("elapsed").alias("elapsed"))


def time_cct(spark, sf_dir):
    return sampling.time_tree(_events(spark, sf_dir))


def uncovered(spark, sf_dir):
    return _rounded(metrics.uncovered(_tree(spark, sf_dir), _burst(spark, sf_dir)), "avg")


def degree_overlap(spark, sf_dir):
    return _rounded(metrics.degree_of_overlap(_tree(spark, sf_dir), _burst(spark, sf_dir)), "overlap")


def counter_error(spark, sf_dir):
    found = metrics.counter_error(_tree(spark, sf_dir), _burst(spark, sf_dir), _threshold(spark, sf_dir), _adjust(spark, sf_dir))
    return _rounded(found, "max_error", "avg_error")


def false_positives(spark, sf_dir):
    t = _threshold(spark, sf_dir)
    return metrics.false_positives(_tree(spark, sf_dir), _burst(spark, sf_dir), t, t // 4)


def hot_coverage_tau(spark, sf_dir):
    return _rounded(metrics.hot_coverage(_tree(spark, sf_dir), _burst(spark, sf_dir), TAU), "coverage")


def hot_coverage_factors(spark, sf_dir):
    return _rounded(metrics.factor_coverage(_tree(spark, sf_dir), _burst(spark, sf_dir), _threshold(spark, sf_dir)), "coverage")


def node_partition(spark, sf_dir):
    t = _threshold(spark, sf_dir)
    return metrics.node_partition(_tree(spark, sf_dir), _burst(spark, sf_dir), _same_paths(spark, sf_dir), t, t)


def counter_accuracy(spark, sf_dir):
    found = metrics.counter_accuracy(_tree(spark, sf_dir), _burst(spark, sf_dir), _same_paths(spark, sf_dir), _threshold(spark, sf_dir), _adjust(spark, sf_dir))
    return _rounded(found.select("matched", "max_error", "avg_error", "over_100"), "max_error", "avg_error")


def adjust_factor(spark, sf_dir):
    total = _burst(spark, sf_dir).agg(F.sum("counter").alias("m"))
    n = _tree(spark, sf_dir).agg(F.sum("counter").alias("n"))
    return total.crossJoin(n).select(F.round(F.col("n") / F.col("m"), 6).alias("factor"))


def sampling_ratios(spark, sf_dir):
    m = _burst(spark, sf_dir).agg(F.sum("counter").alias("m"))
    k = _sampled(spark, sf_dir).agg(F.count("*").alias("k"))
    n = _tree(spark, sf_dir).agg(F.sum("counter").alias("n"))
    share = lambda a: F.round(F.col(a) / F.col("n"), 6)
    return n.crossJoin(m).crossJoin(k).select(share("k").alias("sampled_of_second"), share("m").alias("sampled_of_first"), share("n").alias("second_of_first"))


def summary_report(spark, sf_dir):
    tree, t = _tree(spark, sf_dir), _threshold(spark, sf_dir)
    stats = trees.tree_stats(tree)
    hot = tree.agg(F.sum((F.col("counter") > t).cast("long")).alias("hot_nodes"), F.sum("counter").alias("stream"))
    near = trees.near_hottest(tree, [TAU]).select(F.col("nodes").alias("near_hottest"))
    names = trees.distinct_routines(tree).select(F.col("n_routines").alias("routines"), F.col("n_call_sites").alias("call_sites"))
    row = stats.crossJoin(hot).crossJoin(near).crossJoin(names)  # one row each
    page = pool_bytes(1) - pool_bytes(0)
    size = (F.lit(pool_bytes(0)) + F.ceil(F.col("nodes") / 1024) * page).cast("long")
    return row.select(size.alias("bytes"), "nodes", "stream", "hot_nodes", "sum_counters", "hottest", "near_hottest", "routines", "call_sites")


def region_join(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    regions = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 20).alias("start_addr"), (F.col("s_suppkey") * 20 + 30).alias("end_addr"), F.lit(0).cast("long").alias("offset"), F.col("s_name").alias("pathname"))
    return symbols.in_regions(part, regions, "p_partkey").select("address", "start_addr", "pathname")


def symbol_join(spark, sf_dir):
    uses = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_partkey") + 1).alias("address")).agg(F.count("*").alias("n"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = part.select((F.col("p_partkey") + 1).alias("address"), F.col("p_name").alias("name"), F.col("p_type").alias("file"), F.col("p_brand").alias("image"), F.lit(0).cast("long").alias("offset"))
    found = symbols.with_symbols(uses, table, {"address": "s"})
    return found.select("address", F.col("s_name").alias("name"), F.col("s_image").alias("image"), "n")


def child_similarity(spark, sf_dir):
    """Children of every pair of one path, and of the roots."""
    first, second = matching.described(_tree(spark, sf_dir)), matching.described(_burst(spark, sf_dir))
    pairs = _same_paths(spark, sf_dir).unionByName(spark.createDataFrame([("", "")], "first_path string, second_path string"))
    return matching.pair_scores(first, second, pairs, _adjust(spark, sf_dir)).select("first_path", "second_path", F.round("score", 6).alias("score"))


def match_trees(spark, sf_dir):
    scratch = Scratch(spark, "match-trees")
    first, second = (scratch.table(matching.described(t(spark, sf_dir)), n) for t, n in ((_tree, "first"), (_burst, "second")))
    return matching.match_trees(first, second, _adjust(spark, sf_dir))


def match_summary(spark, sf_dir):
    return matching.match_summary(match_trees(spark, sf_dir), _burst(spark, sf_dir))


def match_status(spark, sf_dir):
    return matching.status_counts(match_trees(spark, sf_dir))


def unmatched_frequency(spark, sf_dir):
    return matching.unmatched_frequency(_tree(spark, sf_dir), match_trees(spark, sf_dir))


def graphviz_lines(spark, sf_dir):
    return texts.graphviz_lines(_tree(spark, sf_dir))


def tree_dump_lines(spark, sf_dir):
    return texts.dump_lines(_tree(spark, sf_dir))


#: Numbers of the log's routines in traces and dumps, which have no names.
NUMBERS = {"signup": 1, "view": 2, "click": 3}


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return _events(spark, sf_dir).withColumn("routine_id", number[F.col("routine_id")].cast("long"))


def trace_round_trip(spark, sf_dir):
    """The exact tree of the log, written as binary traces and read back."""
    folder = Scratch(spark, "traces").path("t").removeprefix("file://")
    traces.write_traces(_numbered(spark, sf_dir).withColumn("ts", F.lit(None).cast("timestamp")), folder)
    return trees.exact_tree(contexts.enters(traces.read_traces_any(spark, folder))).select("path", "counter")


def dump_round_trip(spark, sf_dir):
    """The exact tree, written as a dump and read back; parents are found by id."""
    folder = Scratch(spark, "dumps").path("d")
    last = F.split(F.element_at(F.split("path", "/"), -1), "@")
    nodes = trees.exact_tree(contexts.enters(_numbered(spark, sf_dir))).select("path", "counter", last[0].cast("long").alias("routine_id"), last[1].cast("long").alias("call_site"))
    texts.write_dump(nodes, folder, "cct", [], "events", 0, "/")
    return dumps.with_paths(dumps.read_dumps(spark, folder)).select("path", "depth", "counter")


def console_tree(spark, sf_dir):
    return texts.indented(_tree(spark, sf_dir))


def json_tree(spark, sf_dir):
    return texts.json_tree(_tree(spark, sf_dir))


def _whole_sketch(engine: str, size: int) -> Query:
    return lambda spark, sf_dir: sketches.merged_sketch(sketches.sketch(_enters(spark, sf_dir), engine, size)).select("path", "counter")


def _small_sketch(engine: str, weighted: bool = False) -> Query:
    def run(spark, sf_dir):
        return sketches.sketch(_enters(spark, sf_dir), engine, SMALL, F.col("depth") if weighted else None)

    return run


def _hot_sketch(engine: str) -> Query:
    def run(spark, sf_dir):
        entered = _enters(spark, sf_dir)
        return sketches.hot_trees(sketches.sketch(entered, engine, SMALL), entered, SKETCH_PHI)

    return run


def sketch_report(spark, sf_dir):
    sketched = sketches.merged_sketch(sketches.sketch(_enters(spark, sf_dir), "lss", SMALL))
    return metrics.sketch_report(_tree(spark, sf_dir), sketched, PHI, TAU, SMALL)


def approximate_top(spark, sf_dir):
    return sketches.approximate_top(_enters(spark, sf_dir), 20, 10_000)


def adaptive_burst(spark, sf_dir):
    return sampling.adaptive_tree(sampling.relative_ticks(_enters(spark, sf_dir)), BurstParams(24, 6, re_enabling=5))


def adaptive_burst_weighted(spark, sf_dir):
    return sampling.adaptive_tree(sampling.relative_ticks(_enters(spark, sf_dir)), BurstParams(24, 6, re_enabling=5), compensate=True)


def shallow_tree(spark, sf_dir):
    """A tree of four levels from the order tables: line items by region, nation, segment and priority."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    per_order = read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    per_customer = orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum("n").alias("n"))
    rows = per_customer.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = rows.groupBy(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "o_orderpriority").alias("path")).agg(F.sum("n").alias("counter"))
    sums = trees.subtree_sums(leaves)
    return sums.select("path", depth_of(F.col("path")).alias("depth"), F.col("inclusive").alias("counter"))


def windowed_calls(spark, sf_dir):
    from ..streaming.live import windowed_calls as run

    return run(_events(spark, sf_dir), "1 day", "1 day")


_NAMED = [
    exact_cct, cct_by_thread, merge_threads, underflow_exits, chunked_cct, hot_strict, hot_inclusive, hcct_offline, hcct_trace,
    prune_depth, tree_stats, subtree_sums, subtree_weights, degree_stats, distinct_routines, distinct_routines_trace, tau_count,
    max_phi_table, hot_per_phi, sibling_rank, growth_curve, growth_log, static_burst_walk, static_burst_create, burst_stats,
    wall_clock_bursts, wall_clock_tree, elapsed_ticks, time_cct, uncovered, degree_overlap, counter_error, false_positives, hot_coverage_tau,
    hot_coverage_factors, node_partition, counter_accuracy, adjust_factor, sampling_ratios, summary_report, region_join,
    symbol_join, child_similarity, match_trees, match_summary, match_status, unmatched_frequency, graphviz_lines, tree_dump_lines, trace_round_trip, dump_round_trip, console_tree, json_tree,
    sketch_report, approximate_top, adaptive_burst, adaptive_burst_weighted, shallow_tree, windowed_calls,
]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in _NAMED}
    for engine in ("lss", "bss", "lc"):
        found[f"{engine}_large"] = _whole_sketch(engine, LARGE)
        found[f"{engine}_sketch"] = _small_sketch(engine)
        found[f"{engine}_weighted"] = _small_sketch(engine, weighted=True)
        found[f"{engine}_hot"] = _hot_sketch(engine)
    return found
