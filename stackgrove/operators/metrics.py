"""Accuracy of one tree against another: joins by path and conditional sums, one row out.

`exact` and `other` have path and counter; the root is not a row and is added where a measure
counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import prefixes

#: Multiples of tau, divisors of the least tau, and score thresholds that reports list.
TAU_STEPS = [1, 2, 4, 6, 8, 10]
FACTORS = [0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5]


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def side_by_side(exact: DataFrame, other: DataFrame) -> DataFrame:
    """path, exact, estimate, monitored: every node of the other tree with its exact counter."""
    held = F.col("monitored") if "monitored" in other.columns else F.lit(True)
    eps = F.col("eps") if "eps" in other.columns else F.lit(0).cast("long")
    right = other.select("path", F.col("counter").alias("estimate"), held.alias("monitored"), eps.alias("eps"))
    return right.join(exact.select("path", F.col("counter").alias("exact")), "path", "left")


def missing_exact(exact: DataFrame, other: DataFrame) -> int:
    """Nodes of the other tree that the exact tree lacks; 0 unless the two are of different streams."""
    return other.join(exact.select("path"), "path", "left_anti").count()


def uncovered(exact: DataFrame, other: DataFrame) -> DataFrame:
    """uncovered nodes, their sum, mean and largest counter; null where there are none to divide by."""
    gone = exact.join(other.select("path"), "path", "left_anti")
    return gone.agg(F.count("*").alias("uncovered"), F.coalesce(F.sum("counter"), F.lit(0)).cast("long").alias("sum"), _ratio(F.sum("counter"), F.count("*")).alias("avg"), F.coalesce(F.max("counter"), F.lit(0)).cast("long").alias("max"))


def degree_of_overlap(exact: DataFrame, other: DataFrame) -> DataFrame:
    """Exact counters over the other tree's nodes, in percent of all."""
    seen = exact.join(other.select("path").withColumn("seen", F.lit(1)), "path", "left")
    return seen.agg((F.coalesce(F.sum(F.when(F.col("seen") == 1, F.col("counter"))), F.lit(0)) * 100 / F.sum("counter")).alias("overlap"))


def counter_error(exact: DataFrame, other: DataFrame, threshold: int | Column, adjust: float | Column = 1.0, less_eps: bool = False) -> DataFrame:
    """max_error and avg_error in percent over monitored nodes whose exact counter reaches the threshold; hot, how many."""
    rows = side_by_side(exact, other)
    estimate = F.col("estimate") - (F.col("eps") if less_eps else F.lit(0))
    error = F.abs(F.col("exact") - estimate * adjust) * 100 / F.col("exact")
    kept = rows.filter(F.col("monitored") & (F.col("exact") >= threshold)).withColumn("e", error)
    return kept.agg(F.count("*").alias("hot"), F.max("e").alias("max_error"), _ratio(F.sum("e"), F.count("*")).alias("avg_error"))


def false_positives(exact: DataFrame, other: DataFrame, exact_threshold: int | Column, sketch_threshold: int | Column) -> DataFrame:
    rows = side_by_side(exact, other)
    return rows.agg(_count(F.col("monitored") & (F.col("exact") < exact_threshold) & (F.col("estimate") >= sketch_threshold)).alias("false_positives"))


def hot_coverage(exact: DataFrame, other: DataFrame, tau: int) -> DataFrame:
    """step, nodes, covered, coverage: nodes within step * tau of the hottest, in the exact tree and of those in the other."""
    seen = exact.join(other.select("path").withColumn("seen", F.lit(1)), "path", "left")
    top = F.broadcast(exact.agg(F.max("counter").alias("hottest")))  # one row
    rows = seen.crossJoin(top)
    sums = rows.agg(*[F.struct(_count(F.col("counter") * (s * tau) >= F.col("hottest")).alias("nodes"), _count((F.col("counter") * (s * tau) >= F.col("hottest")) & (F.col("seen") == 1)).alias("covered")).alias(f"s{s}") for s in TAU_STEPS])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"s{s}.nodes").alias("nodes"), F.col(f"s{s}.covered").alias("covered")) for s in TAU_STEPS])).alias("x")).select("x.*")
    return each.withColumn("coverage", _ratio(F.col("covered") * 100, F.col("nodes")))


def factor_coverage(exact: DataFrame, matched: DataFrame, threshold: int | Column) -> DataFrame:
    """factor, threshold, nodes, matched, coverage of the 16 divisors of the least tau; 100 where no node is that hot.

    matched: paths of exact nodes that have a partner. The least tau is (threshold + 1) / hottest.
    """
    seen = exact.join(matched.select("path").distinct().withColumn("seen", F.lit(1)), "path", "left")
    top = exact.agg(F.max("counter").alias("hottest"))
    spark = exact.sparkSession
    factors = spark.createDataFrame([(f,) for f in FACTORS], "factor double")
    # sixteen rows
    marks = F.broadcast(factors.crossJoin(top).withColumn("threshold", F.ceil((F.lit(threshold) + 1) / F.col("hottest") / F.col("factor") * F.col("hottest"))))
    sums = seen.crossJoin(marks).groupBy("factor", "threshold").agg(_count(F.col("counter") >= F.col("threshold")).alias("nodes"), _count((F.col("counter") >= F.col("threshold")) & (F.col("seen") == 1)).alias("matched"))
    return sums.withColumn("coverage", F.when(F.col("nodes") > 0, F.col("matched") * 100 / F.col("nodes")).otherwise(100.0))


def node_partition(exact: DataFrame, other: DataFrame, pairs: DataFrame, exact_min: int | Column, other_min: int | Column) -> DataFrame:
    """hot, cold, false_positives of the other tree's nodes, and false_negatives; pairs: first_path, second_path."""
    partner = pairs.filter("second_path is not null").join(exact.select(F.col("path").alias("first_path"), F.col("counter").alias("exact")), "first_path").select(F.col("second_path").alias("path"), "exact")
    rows = other.join(partner, "path", "left")
    kinds = rows.agg(
        _count(F.col("exact") > exact_min).alias("hot"),
        _count(F.when(F.col("exact").isNull(), F.col("counter") <= other_min).otherwise(F.col("exact") <= exact_min)).alias("cold"),
        _count(F.col("exact").isNull() & (F.col("counter") > other_min)).alias("false_positives"),
    )
    lost = exact.join(pairs.filter("second_path is not null").select(F.col("first_path").alias("path")), "path", "left_anti")
    return kinds.crossJoin(lost.agg(_count(F.col("counter") > exact_min).alias("false_negatives")))


def counter_accuracy(exact: DataFrame, other: DataFrame, pairs: DataFrame, hot_min: int | Column, adjust: float | Column = 1.0, bound: int | None = None) -> DataFrame:
    """matched, max_error, avg_error, under, over, over_100 over hot first nodes that have a partner.

    A difference beyond `bound` counts as under or over and is cut to it; an error over 1 counts in over_100
    and is cut to 1.
    """
    rows = (
        pairs.filter("second_path is not null")
        .join(exact.select(F.col("path").alias("first_path"), F.col("counter").alias("c1")), "first_path")
        .join(other.select(F.col("path").alias("second_path"), F.col("counter").alias("c2")), "second_path")
        .filter(F.col("c1") > hot_min)
    )
    rows = rows.withColumn("a", F.floor(F.col("c2") * adjust)).withColumn("d", F.abs(F.col("a") - F.col("c1")))
    beyond = F.col("d") > bound if bound is not None else F.lit(False)
    error = (F.least("d", F.lit(bound)) if bound is not None else F.col("d")) / F.col("c1")
    rows = rows.withColumn("e", error)
    return rows.agg(
        F.count("*").alias("matched"),
        F.max(F.least("e", F.lit(1.0))).alias("max_error"),
        F.avg(F.least("e", F.lit(1.0))).alias("avg_error"),
        _count(beyond & (F.col("a") < F.col("c1"))).alias("under"),
        _count(beyond & (F.col("a") > F.col("c1"))).alias("over"),
        _count(F.col("e") > 1).alias("over_100"),
    )


def sketch_report(exact: DataFrame, sketched: DataFrame, phi: int, tau: int = 10, epsilon: int | None = None, adjust: float = 1.0) -> DataFrame:
    """All accuracy measures of a sketch's hot tree in one row; phi, tau and epsilon as reciprocals."""
    n = exact.agg(F.sum("counter")).first()[0] or 0
    threshold = n // phi
    wanted = sketched.filter(F.col("monitored") & (F.col("counter") + F.col("delta") >= threshold)).select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    tree = sketched.join(wanted, "path", "left_semi")
    size = tree.agg((F.count("*") + 1).alias("hcct_nodes"))
    best = exact.join(exact.filter(F.col("counter") >= threshold).select(F.explode(prefixes(F.col("path"))).alias("path")).distinct(), "path", "left_semi")
    own = best.agg((F.count("*") + 1).alias("exact_hcct_nodes"), _count(F.col("counter") >= threshold).alias("exact_hot"), (F.sum("counter") * 100 / n).alias("exact_overlap"))
    first = hot_coverage(exact, tree, tau).filter("step = 1").select(F.col("coverage").alias("hot_coverage"))
    parts = [size, false_positives(exact, tree, threshold, threshold), counter_error(exact, tree, threshold, adjust), uncovered(exact, tree).select(*[F.col(c).alias(f"uncovered_{c}" if c != "uncovered" else c) for c in ("uncovered", "sum", "avg", "max")]), degree_of_overlap(exact, tree), first, own]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    return row.withColumns({"threshold": F.lit(threshold), "n": F.lit(n), "phi_reciprocal": F.lit(phi), "epsilon_reciprocal": F.lit(epsilon)})
