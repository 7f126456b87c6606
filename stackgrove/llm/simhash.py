"""Near-duplicates by SimHash and the general pigeonhole principle (operator 1).

Fingerprints within `distance` bits of each other are linked. The 64 bits are ordered so that
correlated ones are neighbours and cut into parts; part i gets a threshold t_i, and as the sum of
all t_i + 1 is distance + 1, two linked fingerprints are within t_i bits in at least one part.
Cuts and thresholds come from a dynamic program over estimated candidate counts. Within t bits in a
part means equal there with some t of its bits masked, so probing is grouping by masked parts.
Candidates are then verified on all 64 bits.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_id, rowwise, texts_of
from .components import components

BITS, WORDS, SEED, DISTANCE = 64, 3, 42, 2
#: Cost of a probed key and of a verified pair, in rows shuffled.
KEY_COST, PAIR_COST = 1.0, 0.1
#: Fingerprints of one key whose pairs are verified one by one; larger groups meet at midpoints.
GROUP = 64


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    n = max(1, len(words) - WORDS + 1)
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid (see row_id), doc_id, fp of every row of docs; a null text is empty."""

    def step():
        return lambda rows: [(row["rid"], row["doc_id"], fingerprint(row["text"])) for row in rows]

    rows = texts_of(docs).select(row_id(F.col("doc_id"), F.col("text")).alias("rid"), "doc_id", "text")
    return rowwise(rows, "rid binary, doc_id long, fp long", step)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and of each pair of bits how often both are set; 4096 sums, whatever the input."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), 1 << 14):
                bits = np.unpackbits(values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(values)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells, pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def order_bits(n: int, both: np.ndarray) -> list[int]:
    """A chain of all bits, each followed by the free one it is most correlated with."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, -1)
    chain = [int(np.argmax(related.max(axis=1)))]
    while len(chain) < BITS:
        row = related[chain[-1]].copy()
        row[chain] = -2
        chain.append(int(np.argmax(row)))
    return chain


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts (their bits) and thresholds that cost least, by a dynamic program over the ordered bits.

    A part with threshold t has a key for each choice of t masked bits. How many others share a key
    is estimated from the rate at which two fingerprints agree on each bit, given that they agree
    on the bit before it in the chain.
    """
    chain = order_bits(n, both)
    p = (np.diag(both) + 0.5) / (n + 1)
    agree = p**2 + (1 - p) ** 2
    given = [math.log(agree[chain[0]])]
    for a, b in itertools.pairwise(chain):
        q = (both[a, b] + 0.25) / (n + 1)
        cells = np.maximum([q, p[a] - q, p[b] - q, 1 - p[a] - p[b] + q], 1e-9)
        given.append(min(0.0, math.log(float((cells**2).sum()) / agree[a])))

    def cost(i: int, j: int, t: int) -> float:
        logs = [math.log(agree[chain[i]]), *given[i + 1 : j]]
        if t > len(logs):
            return math.inf
        whole = math.exp(sum(logs))
        freed = [math.exp(-x) for x in logs]
        sums = [1.0] + [0.0] * t  # elementary symmetric sums: over each choice of masked bits, what masking them gains
        for x in freed:
            for k in range(t, 0, -1):
                sums[k] += x * sums[k - 1]
        return KEY_COST * math.comb(len(logs), t) + PAIR_COST * n * whole * sums[t]

    best = {(0, 0): (0.0, [])}
    for j in range(1, BITS + 1):
        for used in range(1, distance + 2):
            options = []
            for i in range(j):
                for t in range(used):
                    if (before := best.get((i, used - t - 1))) is not None:
                        options.append((before[0] + cost(i, j, t), [*before[1], (i, j, t)]))
            if options:
                best[j, used] = min(options, key=lambda x: x[0])
    return [([chain[k] for k in range(i, j)], t) for i, j, t in best[BITS, distance + 1][1]]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The kept bits of each key, as signed 64-bit integers."""
    out = []
    for bits, t in parts:
        for hidden in itertools.combinations(bits, t):
            kept = sum(1 << b for b in bits if b not in hidden)
            out.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return out


def links(nodes: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """src, dst: enough verified links between nodes (node, fp; each fp once) to give all components.

    Groups of one key of up to GROUP fingerprints give each linked pair. In a larger one each
    fingerprint goes to all values that a flip of half the distance of its free bits gives: two are
    linked exactly if they share such a midpoint, and at most one fingerprint for each flip meets
    there, so a group of any size costs rows in proportion to its members.
    """
    kept = masks(plan(*bit_statistics(nodes), distance))
    array = "array(" + ",".join(f"{m}L" if m >= -(2**63) + 1 else "(-9223372036854775807L - 1L)" for m in kept) + ")"
    keys = nodes.select("node", "fp", F.posexplode(F.expr(f"transform({array}, m -> fp & m)")).alias("part", "key"))
    sizes = scratch.table(keys.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    members = keys.join(sizes, ["part", "key"])
    groups = members.filter(F.col("n") <= GROUP).groupBy("part", "key").agg(F.array_sort(F.collect_list(F.struct("fp", "node"))).alias("g"))
    near = groups.select(
        F.explode(
            F.expr(f"flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, {GROUP}), y -> bit_count(x.fp ^ y.fp) <= {distance}), y -> struct(x.node as src, y.node as dst))))")
        ).alias("e")
    ).select("e.src", "e.dst")
    half = distance // 2
    flips = [sum(1 << b for b in c) for k in range(half + 1) for c in itertools.combinations(range(BITS), k)]
    flips = [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]
    flip = "array(" + ",".join(f"{f}L" if f > -(2**63) else "(-9223372036854775807L - 1L)" for f in flips) + ")"
    crowded = members.filter(F.col("n") > GROUP).select("node", "fp").distinct()
    meet = crowded.select("node", F.explode(F.expr(f"transform({flip}, m -> fp ^ m)")).alias("z")).groupBy("z").agg(F.collect_set("node").alias("g")).filter("size(g) > 1")
    far = meet.select(F.array_min("g").alias("src"), F.explode("g").alias("dst")).filter("src <> dst")
    if distance % 2:  # an odd distance needs one more flip on one side; only even ones are used here
        raise ValueError("distance must be even")
    return near.unionByName(far).distinct()


def classes(docs: DataFrame, spark: SparkSession, distance: int = DISTANCE) -> DataFrame:
    """rid, doc_id, fp, component (its smallest fingerprint), component_id (its smallest doc_id) of every row of docs."""
    scratch = Scratch(spark, "simhash")
    each = scratch.table(fingerprints(docs), "fingerprints")
    nodes = scratch.table(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = components(links(nodes.select(F.col("fp").alias("node"), "fp"), scratch, distance), scratch)
    found = nodes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    found = scratch.table(found, "components")
    firsts = found.groupBy("component").agg(F.min("first").alias("component_id"))
    found = scratch.table(found.join(firsts, "component").select("fp", "component", "component_id"), "classes")
    return each.join(found, "fp").select("rid", "doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, spark: SparkSession, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    A null or empty text has fingerprint zero and is linked like any other. Rows that share a
    doc_id each have a row; a null doc_id keeps its row but names no component, so one without any id has a
    null component_id. Other columns are not read. No rows: no rows.
    """
    return classes(docs, spark, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, spark: SparkSession, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: one each, that of the smallest doc_id.

    Rows with an id come before those without; of rows that share that id the one of the least text hash
    stands, and of rows equal in id and text that of the least hash of all columns but maps. No rows: no rows.
    """
    found = classes(docs, spark, distance)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("m")).select(F.col("m.rid").alias("rid"))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), row_id(F.col("doc_id"), F.col("text")).alias("rid"))
    ones = rows.join(Scratch(spark, "one-of-each").table(kept, "kept"), "rid", "left_semi").groupBy("rid").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return ones.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
