"""Removal of repeated word windows by prefix-partitioned suffix trees (operator 3).

Every window of `depth` words is a suffix of its text cut at that depth; a node of the suffix tree
at that depth with two leaves or more is a repeat. The tree is never built whole:

* Suffixes are dealt by a prefix. It is the one gram of GRAM words within the window that has the
  least hash (its anchor), so neighbouring suffixes share it and travel as one row, a run, and equal
  windows always share a prefix. Prefixes that occur once hold no repeat and are left out; only
  documents with others are read again. Equal runs become one row with their number, so exact copies
  and the inside of a passage cost one row however many documents have them.
* A prefix of up to GROUP runs is one subtree, built in a task: its suffixes, as whole words, are
  sorted, the depth of the node between neighbours is their common prefix, and nodes of full depth
  mark their leaves.
* The prefix of a larger group is lengthened: the windows of a run that reach further to the left
  take the words before the gram to their prefix, the others those after it, and so on by halves
  until groups are small or the prefix is the whole window, when all leaves of a group are equal. Each
  step makes two rows of one at most, and only in groups that are too large.

Windows are compared by their words. Hashes only deal them out: 64 bits of a gram, 128 bits of a
lengthened prefix or of a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_id, rowwise, texts_of

#: Words of a window and of a gram; runs that one task may take into a subtree.
DEPTH, GRAM, GROUP = 35, 10, 2048
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of any stretch from one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            rest = np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([rest[0], r])) for r in rest[1:])
        return self.up[:n], self.down[:n]


_powers = Powers()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    up, down = _powers.to(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    found = (sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1]
    found = (found ^ (found >> np.uint64(32))) * _MIX
    return found ^ (found >> np.uint64(29))


def anchors(hashes: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows that share an anchor: the anchor's hash and place, the first window, how many."""
    grams = stretches(hashes, gram)
    windows = len(hashes) - depth + 1
    place = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, depth - gram + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]].view(np.int64), place[first], first, np.diff(np.append(first, windows))


def with_row_id(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row id; equal rows share one, and so share what is found of them."""
    return texts_of(docs).select("doc_id", "text", row_id(F.col("doc_id"), F.col("text")).alias("rid"))


def prefixes(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """rid, prefix, n: the distinct prefixes of each text and how many rows each has there."""

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                words = words_of(row["text"])
                if len(words) >= depth:
                    found, counts = np.unique(anchors(word_hashes(words), depth, gram)[0], return_counts=True)
                    out += [(row["rid"], p, n) for p, n in zip(found.tolist(), counts.tolist(), strict=True)]
            return out

        return work

    return rowwise(rows.select("rid", "text"), "rid binary, prefix long, n long", step)


def _runs(candidates: DataFrame, depth: int, gram: int) -> DataFrame:
    """rid, first, run, prefix, before, n, words: each run of a candidate text whose prefix is repeated.

    `run` names equal runs; window i of it starts before - i words ahead of the gram.
    """

    def step():
        import xxhash

        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                words, wanted = words_of(row["text"]), set(row["hits"])
                for prefix, place, first, n in zip(*(a.tolist() for a in anchors(word_hashes(words), depth, gram)), strict=True):
                    if prefix in wanted:
                        text, before = b" ".join(words[first : first + n + depth - 1]), place - first
                        out.append((row["rid"], first, xxhash.xxh3_128_digest(text, seed=before), prefix.to_bytes(8, "little", signed=True), before, n, text))
            return out

        return work

    return rowwise(candidates, "rid binary, first int, run binary, prefix binary, before int, n int, words binary", step)


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes (rows of symbols), and the depth of the node between each and the one before it."""
    flat = np.ascontiguousarray(suffixes.astype(">u4")).view(np.dtype((np.void, 4 * suffixes.shape[1]))).ravel()
    order = np.argsort(flat, kind="stable")
    ranked = suffixes[order]
    differ = ranked[1:] != ranked[:-1]
    depths = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    return order, np.concatenate([[0], depths])


def deep_leaves(suffixes: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
    """Whether each suffix lies below an internal node of full depth: it has an equal, or copies of its own."""
    order, depths = subtree(suffixes)
    same = depths == suffixes.shape[1]
    below = np.zeros(len(suffixes), bool)
    below[order] = same | np.append(same[1:], False)
    return below if copies is None else below | (copies > 1)


#: A run within a group: `low` and `high` are the least and the most words before the gram of the windows meant.
RUN = "run binary, prefix binary, before int, n int, copies long, low int, high int, words binary"


def _marks(rows: pa.RecordBatch, depth: int) -> pa.RecordBatch:
    """run, mask (bit i is its window i) of all subtrees of some whole prefixes at once: the prefix leads each suffix, so the sort keeps them apart."""
    number: dict[bytes, int] = {}
    prefix = np.array([number.setdefault(p, len(number)) for p in rows.column("prefix").to_pylist()], np.uint32)
    names: dict[bytes, int] = {}
    words = [[names.setdefault(w, len(names)) for w in x.split(b" ")] for x in rows.column("words").to_pylist()]
    before, n, copies, low, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("before", "n", "copies", "low", "high"))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((w for x in words for w in x), np.uint32, int(sizes.sum()))
    start = np.cumsum(sizes) - sizes
    begin, end = np.maximum(before - high, 0), np.minimum(before - low + 1, n)  # windows of the run that are meant
    count = np.maximum(end - begin, 0)
    owner = np.repeat(np.arange(len(n)), count)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    suffixes = np.empty((len(owner), depth + 2), np.uint32)
    suffixes[:, 0], suffixes[:, 1] = prefix[owner], before[owner] - window
    suffixes[:, 2:] = flat[(start[owner] + window)[:, None] + np.arange(depth)]
    below = deep_leaves(suffixes, copies[owner])
    masks = np.zeros(len(n), np.int64)
    np.bitwise_or.at(masks, owner[below], np.int64(1) << window[below])
    kept = np.flatnonzero(masks)
    return pa.RecordBatch.from_arrays([rows.column("run").take(pa.array(kept)), pa.array(masks[kept], pa.int64())], ["run", "mask"])


def _subtree_marks(rows: DataFrame, depth: int) -> DataFrame:
    """run, mask of groups of up to GROUP rows (RUN): each prefix is put together in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last prefix so far
        for whole in batches:
            for batch in (whole.slice(at, GROUP) for at in range(0, whole.num_rows, GROUP)):
                prefix = batch.column("prefix").to_pylist()
                last = prefix.index(prefix[-1])  # rows before the last prefix; they are in order
                if held and held[-1].column("prefix")[0].as_py() != prefix[0]:
                    yield from each(held)
                    held = []
                if last:
                    yield from each([*held, batch.slice(0, last)])
                    held = []
                held.append(batch.slice(last))
        if held:
            yield from each(held)

    def each(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _marks(pa.concat_batches(parts), depth)

    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "run binary, mask long")


def _lengthened(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """rows (RUN) with longer prefixes: the windows of each half of low to high, where a run has any."""

    def step():
        import xxhash

        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for r in rows:
                words, middle = r["words"].split(b" "), (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    if max(low, r["before"] - r["n"] + 1) <= min(high, r["before"]):
                        shared = words[r["before"] - low : r["before"] + depth - high]
                        out.append((r["run"], xxhash.xxh3_128_digest(b" ".join(shared), seed=low << 32 | high), r["before"], r["n"], r["copies"], low, high, r["words"]))
            return out

        return work

    return rowwise(rows, RUN, step)


def run_marks(runs: DataFrame, scratch: Scratch, depth: int, gram: int) -> DataFrame:
    """run, mask: the windows of each distinct run that occur twice or more; bit i is window i."""
    reach = depth - gram
    distinct = runs.groupBy("run").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("prefix", "before", "n", "words")])
    rows = scratch.table(distinct.select("run", "prefix", "before", "n", "copies", F.lit(0).alias("low"), F.lit(reach).alias("high"), "words"), "runs-0")
    found = []
    span = reach + 1  # windows a prefix of this length may lead
    for level in range(1, depth + 1):
        sizes = rows.groupBy("prefix").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).filter("copies > 1")
        sizes = scratch.table(sizes, f"sizes-{level}")
        small = rows.join(sizes.filter(F.col("rows") <= GROUP).select("prefix"), "prefix", "left_semi").select(*rows.columns)
        found.append(scratch.table(_subtree_marks(small, depth), f"subtrees-{level}"))
        large = sizes.filter(F.col("rows") > GROUP).select("prefix")
        if large.isEmpty():
            break
        large = rows.join(large, "prefix", "left_semi").select(*rows.columns)
        if span == 1:  # the prefix is the whole window
            found.append(large.select("run", F.expr("shiftleft(1L, before - low)").alias("mask")))
            break
        rows, span = scratch.table(_lengthened(large, depth, gram), f"runs-{level}"), -(-span // 2)
        scratch.drop(f"runs-{level - 1}", f"sizes-{level}")
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    return marks.groupBy("run").agg(F.bit_or("mask").alias("mask"))


def removals(rows: DataFrame, scratch: Scratch, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """rid, n_removed, spans (first word, number of words) and kept (the words that stay, joined by one space) of the texts that lose words."""
    gram = min(gram, depth)
    if not 0 < depth <= gram + 62:
        raise ValueError(f"windows must have 1 to {gram + 62} words with grams of {gram}")
    found = scratch.table(prefixes(rows, depth, gram), "found")
    repeated = scratch.table(found.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1").select("prefix"), "prefixes")
    hits = found.select("rid", "prefix").join(repeated, "prefix")
    hits = scratch.table(hits.groupBy("rid").agg(F.collect_set("prefix").alias("hits")), "hits")
    candidates = scratch.table(rows.select("rid", "text").join(hits, "rid"), "candidates")
    runs = scratch.table(_runs(candidates, depth, gram), "runs")
    scratch.drop("found", "prefixes", "hits")
    masks = scratch.table(run_marks(runs, scratch, depth, gram), "masks")
    marks = runs.select("run", "rid", "first").join(masks, "run")
    marks = scratch.table(marks.groupBy("rid").agg(F.collect_set(F.struct("first", "mask")).alias("marks")), "marks")

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                words = words_of(row["text"])
                edges = np.zeros(len(words) + 1, np.int64)
                for mark in row["marks"]:
                    first, mask = mark["first"], mark["mask"]
                    while mask:
                        i = (mask & -mask).bit_length() - 1
                        edges[first + i] += 1
                        edges[first + i + depth] -= 1
                        mask &= mask - 1
                gone = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
                spans = [{"first": a, "words": b - a} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                out.append((row["rid"], int(gone.sum()), spans, kept.decode("utf-8", "surrogatepass")))
            return out

        return work

    losing = candidates.select("rid", "text").join(marks, "rid")
    lost = rowwise(losing, "rid binary, n_removed long, spans array<struct<first: int, words: int>>, kept string", step)
    lost = scratch.table(lost.dropDuplicates(["rid"]), "removals")
    scratch.drop("candidates", "runs", "masks", "marks")
    return lost


def digests(docs: DataFrame, spark: SparkSession, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    A null or empty text has no words and the digest of nothing; a text of fewer than `depth` words
    loses none. Rows that are equal in id and text count as two texts, so both lose what they share.
    Windows are judged on the input. Other columns are not read. No rows: no rows.
    """
    rows = with_row_id(docs)
    lost = removals(rows, Scratch(spark, "substring"), depth)

    def whole():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                words = words_of(row["text"])
                out.append((row["doc_id"], row["rid"], len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            return out

        return work

    every = rowwise(rows, "doc_id long, rid binary, n_words long, sha string", whole)
    lost = lost.select("rid", "n_removed", F.sha2("kept", 256).alias("lost_sha"))
    return every.join(lost, "rid", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("lost_sha", "sha").alias("kept_sha256"))


def repeated_spans(docs: DataFrame, spark: SparkSession, depth: int = DEPTH) -> DataFrame:
    """doc_id, first, words: each longest stretch of words that repeated windows cover; none of a null or short text."""
    rows = with_row_id(docs)
    lost = removals(rows, Scratch(spark, "substring"), depth).select("rid", F.explode("spans").alias("s"))
    return rows.select("doc_id", "rid").join(lost, "rid").select("doc_id", "s.first", "s.words")


def without_repeats(docs: DataFrame, spark: SparkSession, depth: int = DEPTH) -> DataFrame:
    """docs with the repeated windows out of `text`; a text that loses nothing stays as it is, null texts and ids too."""
    key = row_id(F.col("doc_id"), F.col("text"))
    lost = removals(with_row_id(docs), Scratch(spark, "substring"), depth).select(F.col("rid").alias("key"), "kept")
    joined = docs.select(F.struct("*").alias("row"), key.alias("key")).join(lost, "key", "left")  # whole rows, so no name clashes
    return joined.select(*[(F.coalesce("kept", F.col("row.text")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
