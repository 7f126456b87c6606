"""Context trees as rows: node identity is the path; the root (path '', counter 1) is not a row.

Aggregates that count the root say so. `nodes` below have path, depth and counter at least.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import depth_of, parent_path, prefixes
from ..params import overlap_levels


def exact_tree(entered: DataFrame, by_thread: bool = False, weight: Column | None = None) -> DataFrame:
    """Nodes with how often (or with what summed weight) their context was entered; partial sums before the exchange."""
    keys = [*(["tid"] if by_thread else []), "path"]
    counter = F.count("*") if weight is None else F.sum(weight)
    return entered.groupBy(*keys).agg(counter.cast("long").alias("counter")).select(*keys, depth_of(F.col("path")).alias("depth"), "counter")


def merge_threads(trees: DataFrame) -> DataFrame:
    """One tree of the trees of all threads, and how many threads have each node."""
    return trees.groupBy("path").agg(F.sum("counter").alias("counter"), F.count("*").alias("threads")).select("path", depth_of(F.col("path")).alias("depth"), "counter", "threads")


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """Nodes and their missing ancestors, with a counter of 0."""
    each = nodes.select(F.explode(prefixes(F.col("path"))).alias("path"), F.lit(0).cast("long").alias("counter")).distinct()
    both = nodes.select("path", "counter").unionByName(each)
    return both.groupBy("path").agg(F.sum("counter").alias("counter")).select("path", depth_of(F.col("path")).alias("depth"), "counter")


def ancestor_closure(nodes: DataFrame, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """The nodes that `keep` holds for, and their ancestors; hot tells which they are. by: columns that tell trees apart.

    Paths have the ancestors in them, so no recursion is needed, and no second look at the nodes: each
    node goes on as itself, a kept one also as each of its ancestors, and one aggregation by path joins the two.
    """
    keep = F.coalesce(keep, F.lit(False))
    rest = [c for c in nodes.columns if c not in (*by, "path")]
    rows = nodes.select(*by, F.struct(*rest).alias("_n"), keep.alias("_hot"), "path", F.explode(F.when(keep, prefixes(F.col("path"))).otherwise(F.array("path"))).alias("_p"))
    own = F.col("path") == F.col("_p")
    each = rows.groupBy(*by, F.col("_p").alias("path")).agg(F.max(F.when(own, F.col("_n"))).alias("_n"), F.max("_hot").alias("_wanted"), F.max(own & F.col("_hot")).alias("hot"))
    found = each.filter(F.col("_wanted") & F.col("_n").isNotNull())
    return found.select(*[c if c in (*by, "path") else F.col(f"_n.{c}").alias(c) for c in nodes.columns], "hot")


def hot_nodes(nodes: DataFrame, threshold: int | Column, inclusive: bool = False) -> DataFrame:
    """Nodes above (or, inclusive, at) the threshold; an unmonitored node is not hot in an inclusive query."""
    c = F.col("counter")
    if not inclusive:
        return nodes.filter(c > threshold)
    held = F.col("monitored") if "monitored" in nodes.columns else F.lit(True)
    return nodes.filter((c >= threshold) & held)


def hot_tree(nodes: DataFrame, threshold: int | Column, inclusive: bool = False, delta: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Hot nodes and their ancestors, of each tree that `by` names. delta adds a lossy count's error to the counter first."""
    c = F.col("counter") + (F.col("delta") if delta else F.lit(0))
    held = F.col("monitored") if "monitored" in nodes.columns else F.lit(True)
    return ancestor_closure(nodes, (c >= threshold) & held if inclusive else (c > threshold) & held, by)


def prune_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("depth") <= depth)


def tree_stats(nodes: DataFrame) -> DataFrame:
    """nodes, sum_counters, hottest, each with the root."""
    return nodes.agg((F.count("*") + 1).alias("nodes"), (F.coalesce(F.sum("counter"), F.lit(0)) + 1).cast("long").alias("sum_counters"), F.greatest(F.max("counter"), F.lit(1)).cast("long").alias("hottest"))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """path, inclusive (node and descendants) and exclusive (descendants only) counter sums.

    Each counter goes to all its prefixes; partial sums keep the exchange near the tree's size.
    """
    spread = nodes.select("path", "counter", F.explode(prefixes(F.col("path"))).alias("_p"))
    own = F.sum(F.when(F.col("path") == F.col("_p"), F.col("counter")))
    sums = spread.groupBy(F.col("_p").alias("path")).agg(F.sum("counter").alias("inclusive"), own.alias("own"))
    return sums.select("path", "inclusive", (F.col("inclusive") - F.coalesce("own", F.lit(0))).alias("exclusive"))


def degrees(nodes: DataFrame) -> DataFrame:
    """avg_degree (edges by inner nodes, the root always one) and max_degree."""
    children = nodes.groupBy(parent_path(F.col("path")).alias("parent")).agg(F.count("*").alias("n"))
    inner = F.greatest(F.count("*"), F.lit(1))
    return children.agg((F.coalesce(F.sum("n"), F.lit(0)) / inner).alias("avg_degree"), F.coalesce(F.max("n"), F.lit(0)).alias("max_degree"))


def distinct_routines(nodes: DataFrame, with_root: bool = False) -> DataFrame:
    """n_routines and n_call_sites (pairs of routine and site); with_root counts its number 0 too."""
    last = F.element_at(F.split("path", "/"), -1)
    extra = F.lit(1 if with_root else 0)
    return nodes.agg((F.count_distinct(F.substring_index(last, "@", 1)) + extra).alias("n_routines"), (F.count_distinct(last) + extra).alias("n_call_sites"))


def near_hottest(nodes: DataFrame, factors: list[int]) -> DataFrame:
    """tau and how many nodes have counter * tau >= the hottest counter (the root is counted where it is that hot)."""
    top = F.broadcast(nodes.agg(F.greatest(F.coalesce(F.max("counter"), F.lit(1)), F.lit(1)).cast("long").alias("hottest")))  # one row
    counts = nodes.crossJoin(top).agg(F.first("hottest").alias("hottest"), *[F.sum((F.col("counter") * t >= F.col("hottest")).cast("long")).alias(f"t{t}") for t in factors])
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), (F.coalesce(F.col(f"t{t}"), F.lit(0)) + F.when(F.lit(t) >= F.col("hottest"), 1).otherwise(0)).cast("long").alias("n")) for t in factors])
    return counts.select(F.explode(rows).alias("x")).select("x.tau", F.col("x.n").alias("nodes"))


def max_phi_table(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Of each degree of overlap: the 0-based index in falling counters at which it is reached, and that counter.

    Counters are first summed by value: the ordered pass reads one row for each distinct counter,
    however many nodes there are.
    """
    runs = nodes.groupBy("counter").agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("counter")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("total", F.sum(F.col("counter") * F.col("k")).over(down)).withColumn("count", F.sum("k").over(down))
    runs = runs.withColumn("before", F.col("total") - F.col("counter") * F.col("k")).withColumn("count_before", F.col("count") - F.col("k"))
    total = nodes.agg(F.sum("counter").alias("n")) if n is None else nodes.sparkSession.createDataFrame([(n,)], "n long")
    spark = nodes.sparkSession
    levels = spark.createDataFrame(list(enumerate(overlap_levels())), "level int, overlap double")
    need = levels.crossJoin(F.broadcast(total)).withColumn("need", F.col("n") * F.col("overlap") / 100)
    hits = F.broadcast(need).join(runs, (F.col("total") >= F.col("need")) & ((F.col("before") < F.col("need")) | (F.col("count_before") == 0)))
    first = F.greatest(F.ceil((F.col("need") - F.col("before")) / F.col("counter")) - 1, F.lit(0))
    found = hits.select("level", "overlap", (F.col("count_before") + first).cast("long").alias("hot_nodes"), F.col("counter").alias("min_counter"), F.struct("count_before").alias("_o"))
    found = found.groupBy("level", "overlap").agg(F.min_by("hot_nodes", "_o").alias("hot_nodes"), F.min_by("min_counter", "_o").alias("min_counter"))
    whole = nodes.agg(F.count("*").alias("hot_nodes"), F.min("counter").alias("min_counter"))
    return found.unionByName(whole.select(F.lit(len(overlap_levels())).alias("level"), F.lit(100.0).alias("overlap"), "hot_nodes", "min_counter"))


def hot_per_phi(nodes: DataFrame, reciprocals: list[int]) -> DataFrame:
    """Of each phi: threshold, nodes of the hot tree (with the root) and hot nodes."""
    n = F.broadcast(nodes.agg(F.sum("counter").alias("n")))  # one row
    steps = nodes.sparkSession.createDataFrame([(r,) for r in reciprocals], "phi_reciprocal long")
    marks = F.broadcast(steps.crossJoin(n).withColumn("threshold", F.floor(F.col("n") / F.col("phi_reciprocal"))))  # one row for each phi
    hot = nodes.crossJoin(marks).filter(F.col("counter") >= F.col("threshold"))
    kept = hot.select("phi_reciprocal", F.explode(prefixes(F.col("path"))).alias("path")).distinct().groupBy("phi_reciprocal").agg(F.count("*").alias("n_kept"))
    count = hot.groupBy("phi_reciprocal").agg(F.count("*").alias("n_hot"))
    joined = marks.join(kept, "phi_reciprocal", "left").join(count, "phi_reciprocal", "left")
    return joined.select("phi_reciprocal", "threshold", (F.coalesce("n_kept", F.lit(0)) + 1).alias("nodes"), F.coalesce("n_hot", F.lit(0)).alias("hot_nodes"))


def sibling_rank(nodes: DataFrame) -> DataFrame:
    """path, counter and rank among siblings by falling counter, ties by path."""
    w = Window.partitionBy(parent_path(F.col("path"))).orderBy(F.desc("counter"), "path")
    return nodes.select("path", "counter", F.row_number().over(w).cast("long").alias("rank"))


def growth_log(entered: DataFrame, every: int = 100_000) -> DataFrame:
    """nodes and ts: when the tree had each multiple of `every` nodes.

    First sights are counted by day, so days are numbered alone, each from the sum of those before it.
    """
    first = entered.groupBy("path").agg(F.min(F.struct("ts", "tid", "seq")).alias("_at")).withColumn("_day", F.to_date("_at.ts"))
    days = first.groupBy("_day").agg(F.count("*").alias("_new"))
    before = days.select("_day", (F.sum("_new").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_new")).alias("_before"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("_day").orderBy("_at"))).join(before, "_day")
    return ranked.select((F.col("_before") + F.col("_n")).alias("nodes"), F.col("_at.ts").alias("ts")).filter(F.col("nodes") % every == 0)


def growth_curve(entered: DataFrame) -> DataFrame:
    """day, nodes and events: contexts known and enters seen by the end of each day, over all threads.

    First sights and enters are summed by day before the running sum, so what is put in one place
    is one row a day.
    """
    day = F.to_date("ts")
    first = entered.groupBy("path").agg(F.min(day).alias("day")).groupBy("day").agg(F.count("*").alias("new"), F.lit(0).cast("long").alias("enters"))
    every = entered.groupBy(day.alias("day")).agg(F.lit(0).cast("long").alias("new"), F.count("*").alias("enters"))
    days = first.unionByName(every).groupBy("day").agg(F.sum("new").alias("new"), F.sum("enters").alias("enters"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select("day", F.sum("new").over(w).alias("nodes"), F.sum("enters").over(w).alias("events"))
