"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test (operator 8).

Vectors are scaled to unit length, so the nearest by cosine is the nearest by distance. A Gaussian
(2-stable) projection to DIMENSIONS numbers keeps squared distances up to a chi-square factor. A
kd-tree over the projections of a sample cuts the space into cells; every vector is put into its
cell, in blocks of bounded size. A query visits blocks, and leaves in them, in the order of their
boxes' projected distance, and verifies the vectors there that the test lets through in full. Once the
true distance of its k-th nearest is d, a vector that is nearer but projected to r or beyond has a
chance of at most 1 - F(r * r / d / d), F being the chi-square distribution; when that falls to MISS,
the search stops.

In the cluster a query first searches its own cell, and then, with the d that gives, all others
the test doesn't rule out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, rowwise

DIMENSIONS, NEIGHBOURS, MISS, SEED = 8, 5, 0.001, 11
#: Vectors the cells are cut from at most, vectors meant for a cell or block, leaves of a block's tree, and
#: queries searched at once.
SAMPLE, BLOCK, LEAF, QUERIES = 20_000, 1024, 128, 256
#: Digits to which scores are compared until they are computed anew, so that equal vectors tie.
DIGITS = 12


def chi_square(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """The chi-square distribution function for an even number m of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, m // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def reach(miss: float = MISS, m: int = DIMENSIONS) -> float:
    """The quotient r * r / d / d from which on the stopping test holds."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), m) < 1 - miss else (low, mid)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, DIMENSIONS))


def boxes_of(points: np.ndarray, size: int) -> tuple[list[tuple[int, float]], list[np.ndarray], np.ndarray, np.ndarray]:
    """A kd-tree of leaves of up to `size` points: splits (heap order), leaves, and the cells' low and high corners.

    A cell's box is its share of the whole space, so it also bounds points that come later.
    """
    splits: list[tuple[int, float]] = []
    leaves: list[np.ndarray] = []
    lows, highs = [], []

    def cut(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        here = points[ids]
        spread = here.max(axis=0) - here.min(axis=0) if len(ids) else np.zeros(points.shape[1])
        axis = int(np.argmax(spread))
        if len(ids) <= size or spread[axis] == 0:
            leaves.append(ids)
            lows.append(low)
            highs.append(high)
            return -len(leaves)
        at = float(np.median(here[:, axis]))
        right = here[:, axis] >= at
        if right.all():
            right = here[:, axis] > at
            at = float(here[right, axis].min())
        place = len(splits)
        splits.append((axis, at))
        children.append((0, 0))
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = at
        children[place] = cut(ids[~right], low, left_high), cut(ids[right], right_low, high)
        return place

    children: list[tuple[int, int]] = []
    cut(np.arange(len(points)), np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))
    return [(*s, *c) for s, c in zip(splits, children, strict=True)], leaves, np.array(lows), np.array(highs)


class Cells:
    """The cells of the projected space; its size follows the sample's bound and the number of cells."""

    def __init__(self, sample: np.ndarray, size: int):
        self.projection = projection(sample.shape[1])
        self.splits, leaves, self.low, self.high = boxes_of(sample @ self.projection, size)
        self.count = len(leaves)

    def cell(self, projected: np.ndarray) -> np.ndarray:
        at = np.zeros(len(projected), np.int64) if self.splits else np.full(len(projected), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]).tolist():
                rows = inner[at[inner] == node]
                axis, value, left, right = self.splits[node]
                at[rows] = np.where(projected[rows, axis] >= value, right, left)
        return -at - 1

    def distance(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each cell's box."""
        gap = np.maximum(np.maximum(self.low[None] - projected[:, None], projected[:, None] - self.high[None]), 0)
        return (gap**2).sum(axis=2)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components near 1: exact, and squares stay finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of each row with its counterpart, summed from the first component to the last, so that it is the same everywhere."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, project: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[int, int, float]]:
    """(query, vector, cosine) of up to 2 * k found for each query in one block, by its kd-tree.

    bounds: of each query the squared distance of its k-th nearest so far. A query isn't its own
    neighbour; ties go to the smaller id.
    """
    _, leaves, _, _ = boxes_of(vectors @ project, LEAF)
    points = vectors @ project
    low = np.array([points[x].min(axis=0) for x in leaves])
    high = np.array([points[x].max(axis=0) for x in leaves])
    at = queries @ project
    gap = np.maximum(np.maximum(low[None] - at[:, None], at[:, None] - high[None]), 0)
    far = (gap**2).sum(axis=2)
    stop, out = reach(), []
    for q, order in enumerate(np.argsort(far, axis=1, kind="stable")):
        bound = float(bounds[q])
        found_ids, found = np.empty(0, np.int64), np.empty(0)
        for leaf in order.tolist():
            if far[q, leaf] >= stop * bound:
                break
            rows = leaves[leaf]
            rows = rows[(ids[rows] != query_ids[q]) & (((points[rows] - at[q]) ** 2).sum(axis=1) < stop * bound)]
            found_ids, found = np.concatenate([found_ids, ids[rows]]), np.concatenate([found, np.round(vectors[rows] @ queries[q], DIGITS)])
            best = np.lexsort((found_ids, -found))[: 2 * k]
            found_ids, found = found_ids[best], found[best]
            if len(found) >= k:
                bound = min(bound, max(0.0, 2 - 2 * float(found[k - 1])) + 1e-11)
        out += [(int(query_ids[q]), int(i), float(s)) for i, s in zip(found_ids, found, strict=True)]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the vectors that take part: not null or zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, spark: SparkSession, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: up to k nearest found of each row whose id is divisible by `every`.

    score is the cosine in double precision, of the original vectors. Null and zero vectors and those with null
    or non-finite components take no part; vectors of another length than most of the sample's
    neither. A query with no other vector gives no rows. Of rows that share an id the one of the least bytes counts.
    Other columns are not read. No rows: no rows.
    """
    scratch = Scratch(spark, "neighbours")
    rows = usable(df, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(r["v"]) for r in sample]
    size = max(set(lengths), key=lengths.count)
    rows = rows.filter(F.size("v") == size)
    total = rows.count()
    points = unit(np.array([r["v"] for r in sample if len(r["v"]) == size]))
    cells = Cells(points, max(8, math.ceil(BLOCK * len(points) / max(1, total))))
    shared = spark.sparkContext.broadcast(cells)

    def place():
        tree = shared.value

        def work(rows: list[dict]) -> list[tuple]:
            vectors = np.array([r["v"] for r in rows])
            return [(r["id"], c, v.tobytes()) for r, c, v in zip(rows, tree.cell(unit(vectors) @ tree.projection).tolist(), vectors, strict=True)]

        return work

    least = rowwise(rows, "id long, cell int, v binary", place).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("m"))
    placed = scratch.table(least.select("id", "m.cell", "m.v"), "placed")
    # a cell that many vectors share is cut into blocks by a hash of the id; one row of counts for each cell
    sizes = F.broadcast(placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (2 * BLOCK)).cast("int")).select("cell", "blocks"))
    blocked = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    index = scratch.table(blocked.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("members")), "index")
    queries = placed.filter(F.col("id") % every == 0).withColumn("bound", F.lit(4.0))

    def found(visits: DataFrame) -> DataFrame:
        """visits (id, v, bound, cell) searched in all blocks of their cells, some queries at once."""
        chunked = visits.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        counts = chunked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
        chunked = chunked.join(counts, ["cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), "chunks"))
        groups = chunked.groupBy("cell", "block", "chunk").agg(F.collect_list(F.struct("id", "v", "bound")).alias("queries"))

        def step():
            project = shared.value.projection

            def work(rows: list[dict]) -> list[tuple]:
                out = []
                for r in rows:
                    ids = np.array([m["id"] for m in r["members"]])
                    order = np.argsort(ids)
                    vectors = unit(np.frombuffer(b"".join(m["v"] for m in r["members"])).reshape(len(ids), -1))[order]
                    asked = sorted(r["queries"], key=lambda q: q["id"])
                    out += search(ids[order], vectors, np.array([q["id"] for q in asked]), unit(np.frombuffer(b"".join(q["v"] for q in asked)).reshape(len(asked), -1)), np.array([q["bound"] for q in asked]), project, k)
                return out

            return work

        return rowwise(groups.join(index, ["cell", "block"]).select("members", "queries"), "query_id long, vec_id long, score double", step)

    first = scratch.table(found(queries), "first")
    # the k-th best so far bounds the rest of the search; fewer than k give no bound
    top = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, F.greatest(2 - 2 * F.element_at("s", k), F.lit(0.0)) + 1e-11).otherwise(4.0).alias("bound"))

    def onward():
        tree, stop = shared.value, reach()

        def work(rows: list[dict]) -> list[tuple]:
            vectors = unit(np.array([np.frombuffer(r["v"]) for r in rows]))
            far = tree.distance(vectors @ tree.projection)
            return [(r["id"], r["v"], r["bound"], c) for r, d in zip(rows, far, strict=True) for c in np.flatnonzero(d < stop * r["bound"]).tolist() if c != r["cell"]]

        return work

    bounded = queries.drop("bound").join(top, "id", "left").fillna({"bound": 4.0})
    rest = found(rowwise(bounded, "id long, v binary, bound double, cell int", onward))
    both = first.unionByName(rest)
    best = both.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id"))), 1, 4 * k).alias("near"))
    pairs = best.select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id")
    a, b = placed.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), placed.select(F.col("id").alias("vec_id"), F.col("v").alias("cv"))

    def exact():
        def work(rows: list[dict]) -> list[tuple]:
            x, y = (scaled(np.array([np.frombuffer(r[c]) for r in rows])) for c in ("qv", "cv"))
            score = dot(x, y) / np.sqrt(dot(x, x)) / np.sqrt(dot(y, y))
            return [(r["query_id"], r["vec_id"], s) for r, s in zip(rows, score.tolist(), strict=True)]

        return work

    scored = rowwise(pairs.join(a, "query_id").join(b, "vec_id"), "query_id long, vec_id long, score double", exact)
    ranked = scored.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id", "score"))), 1, k).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
