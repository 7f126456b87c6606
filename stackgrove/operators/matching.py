"""Node-to-node matching of two trees, level by level.

Children of matched pairs meet in a join on the pair; scores are column expressions; only the
one-to-one assignment within a pair's children is Python. Children rows have path, parent, counter,
weight (counters of descendants) and the symbol columns of routine (r_*) and call site (s_*).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import UNRESOLVED, counter_score, heuristic_score, parent_path, symbol_score
from .trees import subtree_sums

MATCHED, APPROXIMATE, NOT_MATCHED = "MATCHED", "APX_MATCHED", "NOT_MATCHED"
#: Children of one side up to which the assignment is exact: full comparison, quick comparison.
EXACT_FULL, EXACT_QUICK = 9, 12
PARTS = ["name", "file", "image", "offset"]
SCHEMA = "first_path string, second_path string, status string, score double"
from ..scratch import Scratch


def described(nodes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Nodes with parent, subtree weight and symbols; without a symbol table a routine's name is its own."""
    last = F.element_at(F.split("path", "/"), -1)
    rows = nodes.join(subtree_sums(nodes).select("path", F.col("exclusive").alias("weight")), "path").withColumn("parent", parent_path(F.col("path")))
    routine, site = F.substring_index(last, "@", 1), last
    if symbols is None:
        for side, text in (("r", routine), ("s", site)):
            rows = rows.withColumns({f"{side}_name": text, f"{side}_file": F.lit("events"), f"{side}_image": F.lit("log"), f"{side}_offset": F.crc32(text.cast("binary"))})
        return rows
    table = symbols.select(F.col("address").cast("string").alias("_a"), *PARTS).dropDuplicates(["_a"])
    for side, key in (("r", routine), ("s", F.substring_index(last, "@", -1))):
        named = table.select("_a", *[F.col(p).alias(f"{side}_{p}") for p in PARTS])
        rows = rows.withColumn("_a", key).join(named, "_a", "left").drop("_a")
        rows = rows.withColumns({f"{side}_{p}": F.coalesce(f"{side}_{p}", F.lit(UNRESOLVED)) for p in PARTS if p != "offset"})
    return rows


def _symbol(prefix: str, side: str) -> dict[str, Column]:
    return {p: F.col(f"{prefix}.{side}_{p}") for p in PARTS}


def pair_scores(first: DataFrame, second: DataFrame, pairs: DataFrame, adjust: float = 1.0) -> DataFrame:
    """All children of each matched pair against each other: score and the greedy heuristic."""
    a, b = first.alias("a"), second.alias("b")
    met = pairs.alias("p").join(a, F.col("p.first_path") == F.col("a.parent")).join(b, F.col("p.second_path") == F.col("b.parent"))
    factor = F.lit(float(adjust))
    parts = symbol_score(_symbol("a", "r"), _symbol("b", "r")) + symbol_score(_symbol("a", "s"), _symbol("b", "s"))
    score = parts / 100 + counter_score(F.col("a.counter"), F.col("b.counter"), factor)
    return met.select(
        F.col("p.first_path").alias("first_parent"),
        F.col("p.second_path").alias("second_parent"),
        F.col("a.path").alias("first_path"),
        F.col("b.path").alias("second_path"),
        F.col("a.counter").alias("first_counter"),
        F.col("b.counter").alias("second_counter"),
        score.alias("score"),
        heuristic_score(F.col("a.weight"), F.col("b.weight"), factor).alias("heuristic"),
    )


def best_assignment(scores: list[list[float]]) -> list[int]:
    """For each row the column it gets (or -1), so that the sum of scores is greatest; rows <= columns.

    A dynamic program over the rows and the set of columns taken. Of equal sums, earlier rows take
    earlier columns.
    """
    n, m = len(scores), len(scores[0]) if scores else 0
    if n > m:
        taken = best_assignment([list(c) for c in zip(*scores, strict=True)])
        out = [-1] * n
        for column, row in enumerate(taken):
            if row >= 0:
                out[row] = column
        return out
    best: list[dict[int, float]] = [{0: 0.0}]
    for row in scores:
        following: dict[int, float] = {}
        for mask, total in best[-1].items():
            for c in range(m):
                if not mask >> c & 1:
                    new = mask | 1 << c
                    if total + row[c] > following.get(new, -1.0) + 1e-12:
                        following[new] = total + row[c]
        best.append(following)
    # of the sets that reach the greatest sum, walk back preferring late columns for late rows
    mask = max(best[-1], key=lambda k: (round(best[-1][k], 9), -k)) if best[-1] else 0
    out = [-1] * n
    for i in range(n - 1, -1, -1):
        for c in range(m - 1, -1, -1):
            if mask >> c & 1 and (before := best[i].get(mask ^ 1 << c)) is not None and abs(before + scores[i][c] - best[i + 1][mask]) < 1e-9:
                out[i], mask = c, mask ^ 1 << c
                break
    return out


def greedy_assignment(scores: list[list[float]], extra: list[list[float]]) -> list[int]:
    """For each row the free column of greatest score plus extra, where its score is above 0; the first of equals."""
    taken: set[int] = set()
    out = []
    for row, more in zip(scores, extra, strict=True):
        choice, top = -1, 0.0
        for c, (s, h) in enumerate(zip(row, more, strict=True)):
            if c not in taken and s + h > top:
                choice, top = c, s + h
        taken.add(choice)
        out.append(choice)
    return out


def assign(rows: list[tuple], limit: int) -> list[tuple[str, str, str, float]]:
    """One-to-one pairs of one parent pair's children, both sides by falling counter, then path.

    rows: first_path, second_path, first_counter, second_counter, score, heuristic of each two children.
    """
    firsts = [p for p, _ in sorted({(r[0], r[2]) for r in rows}, key=lambda x: (-x[1], x[0]))]
    seconds = [p for p, _ in sorted({(r[1], r[3]) for r in rows}, key=lambda x: (-x[1], x[0]))]
    cells = {(r[0], r[1]): (r[4], r[5]) for r in rows}
    scores = [[cells[a, b][0] for b in seconds] for a in firsts]
    extra = [[cells[a, b][1] for b in seconds] for a in firsts]
    if max(len(firsts), len(seconds)) <= limit:
        chosen, status = best_assignment(scores), MATCHED
    elif len(firsts) <= len(seconds):
        chosen, status = greedy_assignment(scores, extra), APPROXIMATE
    else:
        chosen, status = [-1] * len(firsts), APPROXIMATE
        for b, a in enumerate(greedy_assignment([list(c) for c in zip(*scores, strict=True)], [list(c) for c in zip(*extra, strict=True)])):
            if a >= 0:
                chosen[a] = b
    return [(firsts[a], seconds[b], status, scores[a][b]) for a, b in enumerate(chosen) if b >= 0 and scores[a][b] > 0]


def _assigned(scored: DataFrame, limit: int) -> DataFrame:
    """assign() of each parent pair: sorted batches pass through, so a task holds the children of one pair."""
    kind = T._parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)
    keys = ["first_parent", "second_parent"]
    columns = [*keys, "first_path", "second_path", "first_counter", "second_counter", "score", "heuristic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:2] != now:
                    out += assign(held, limit) if held else []
                    now, held = row[:2], []
                held.append(row[2:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if held and (out := assign(held, limit)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return scored.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def match_trees(first: DataFrame, second: DataFrame, adjust: float = 1.0, limit: int = EXACT_FULL, checkpoint=None, levels: int = 1024) -> DataFrame:
    """first_path, second_path, status, score: the root pair, matched pairs, and nodes of the first without one.

    first and second: rows of described(), best from a table. Each level is written to a scratch table, or
    handed to checkpoint(df, name) if given, which should write to storage that outlives executors.
    """
    spark = first.sparkSession
    keep = checkpoint or Scratch(spark, "match").table
    frontier = spark.createDataFrame([("", "", MATCHED, 1.0)], SCHEMA)
    found = frontier
    for level in range(1, levels + 1):
        scored = pair_scores(first, second, frontier, adjust)
        frontier = keep(_assigned(scored, limit), f"level-{level}")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    lost = first.select("path").join(found.select(F.col("first_path").alias("path")), "path", "left_anti")
    return found.unionByName(lost.select(F.col("path").alias("first_path"), F.lit(None).cast("string").alias("second_path"), F.lit(NOT_MATCHED).alias("status"), F.lit(0.0).alias("score")))


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("nodes"))


def unmatched_frequency(first: DataFrame, matches: DataFrame) -> DataFrame:
    """avg and max counter of the first tree's nodes without a partner; 0 where there are none."""
    lost = first.join(matches.filter("second_path is null").select(F.col("first_path").alias("path")), "path", "left_semi")
    return lost.agg(F.count("*").alias("unmatched"), F.coalesce(F.avg("counter"), F.lit(0.0)).alias("avg"), F.coalesce(F.max("counter"), F.lit(0)).alias("max"))


#: The score thresholds that match summaries list.
SCORE_STEPS = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]


def match_summary(matches: DataFrame, second: DataFrame) -> DataFrame:
    """threshold, at_least (matched nodes of that score, the root among them), share of matched, and totals."""
    is_matched = F.col("second_path").isNotNull()
    totals = matches.agg(F.sum(is_matched.cast("long")).alias("matched"), F.sum((~is_matched).cast("long")).alias("first_unmatched"), *[F.sum((is_matched & (F.col("score") >= t)).cast("long")).alias(f"t{i}") for i, t in enumerate(SCORE_STEPS)])
    size = second.agg((F.count("*") + 1).alias("second_nodes"))
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("at_least")) for i, t in enumerate(SCORE_STEPS)])
    each = totals.crossJoin(size).select("matched", "first_unmatched", (F.col("second_nodes") - F.col("matched")).alias("second_unmatched"), F.explode(rows).alias("x"))
    return each.select("x.threshold", "x.at_least", (F.col("x.at_least") * 100 / F.col("matched")).alias("share"), "matched", "first_unmatched", "second_unmatched")
