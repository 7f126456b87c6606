"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 10).

Terms are all words of the training texts and the beginnings of their longer words; none is left out. A weight is
(1 + log tf) * idf * gain: document frequencies count every document of the corpus, and the gain,
at least 1, grows with how far the share of toxic texts among those with the term is from the
overall share. Training texts become unit vectors; equal texts are one example with its votes. The
examples lie in an inverted index in blocks, with each term's largest weight in each block; blocks
are visited by their bound until no other can hold a nearer example, so the neighbours are exact.
Votes weigh by closeness and are shrunk towards the training rate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, rowwise, texts_of
from .quality import held_out, labelled_sample, within

#: Labelled rows to learn from and distinct terms in all of them at most (whole rows), neighbours that vote, examples in a block.
TRAIN_ROWS, TRAIN_TERMS, NEIGHBOURS, BLOCK = 2048, 4_000_000, 15, 64
#: Share of the examples from which on a term is a row of the index's table; queries answered at once.
DENSE, QUERIES = 0.06, 32
#: Length of the word beginnings that are terms too, and what ends them.
BEGINNING, MARK = 5, "*"
#: How strongly the gain of a term raises its weight; texts of the overall share added to a term's own.
BOOST, SMOOTH = 20.0, 5.0
#: Weight of the training rate beside the votes.
PRIOR = 2.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Texts whose scores a worker keeps.
KEPT = 50_000


def words_of(text: str) -> Counter:
    """How often each match of WORD occurs in the whole text; most stretches between blanks are one already."""
    words = Counter(text.lower().split())
    for part in [p for p in words if not p.isalpha()]:
        n = words.pop(part)
        for word in WORD.findall(part):
            words[word] += n
    return words


def terms_of(text: str) -> Counter:
    """How often each term occurs in the whole text."""
    words = words_of(text)
    out = Counter(words)
    for word, n in words.items():
        if len(word) > BEGINNING:
            out[word[:BEGINNING] + MARK] += n
    return out


class Numbers:
    """Reads texts as numbers of known terms (in order)."""

    def __init__(self, terms: list[str]):
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith(MARK)}
        self.beginnings = {t.removesuffix(MARK): i for i, t in enumerate(terms) if t.endswith(MARK)}

    def _of(self, words: Iterable[str], long: list[str]) -> np.ndarray:
        return np.array([*map(self.words.get, words, repeat(-1)), *map(self.beginnings.get, long, repeat(-1))], np.int64)

    def present(self, text: str) -> np.ndarray:
        words = words_of(text)
        found = self._of(words, list({w[:BEGINNING] for w in words if len(w) > BEGINNING}))
        return found[found >= 0]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of the text in order, and how often each occurs."""
        words = words_of(text)
        long = [(w[:BEGINNING], n) for w, n in words.items() if len(w) > BEGINNING]
        found = self._of(words, [w for w, _ in long])
        times = np.array([*words.values(), *(n for _, n in long)], np.int64)[found >= 0]
        unique, place = np.unique(found[found >= 0], return_inverse=True)
        return unique, np.bincount(place, times, len(unique)).astype(np.int64)


def document_frequencies(docs: DataFrame, spark: SparkSession, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are; a count for each term, whatever the corpus."""
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, reader = np.zeros(len(shared.value) + 1, np.int64), Numbers(shared.value)
        for batch in batches:
            for text in batch.column("text"):
                found[reader.present(text.as_py())] += 1
            found[-1] += batch.num_rows
        kept = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(found[kept], pa.int64())], ["term", "n"])

    sums = texts_of(docs).select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def gains(terms: int, examples: list[tuple[np.ndarray, float]], rate: float) -> np.ndarray:
    """Of each term 1 + BOOST times the divergence of its share of toxic texts, smoothed, from the overall one."""
    n, bad = np.zeros(terms), np.zeros(terms)
    for at, share in examples:
        n[at] += 1
        bad[at] += share
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    share = np.clip((bad + SMOOTH * rate) / (n + SMOOTH), 1e-9, 1 - 1e-9)
    return 1 + BOOST * np.maximum(share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)), 0)


class BlockMaxIndex:
    """Examples (term numbers in order, weights) in blocks of BLOCK; nearest() is exact.

    Postings are sorted by term and example. A term's postings within a block are an entry, with
    their largest weight. Terms that a DENSE share of the examples have are rows of a table instead,
    so their part of a score is exact from the start, and of a bound too.
    """

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.count, self.blocks = len(examples), max(1, -(-len(examples) // BLOCK))
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in examples)]).astype(np.int64)
        weight = np.concatenate([np.empty(0), *(w for _, w in examples)])
        example = np.repeat(np.arange(len(examples)), [len(t) for t, _ in examples])
        common = np.flatnonzero(np.bincount(term, minlength=terms) >= max(1, DENSE * self.count))
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.blocks * BLOCK))
        long = self.row[term] >= 0
        self.table[self.row[term[long]], example[long]] = weight[long]
        order = np.lexsort((example[~long], term[~long]))
        term, self.example, self.weight = term[~long][order], example[~long][order], weight[~long][order]
        key = term * self.blocks + self.example // BLOCK
        self.start = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        self.block = self.example[self.start[:-1]] // BLOCK
        self.top = np.maximum.reduceat(self.weight, self.start[:-1]) if len(key) else np.empty(0)
        self.entries = np.searchsorted(term[self.start[:-1]], np.arange(terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """Of each query (term numbers, weights): (cosine, example) of the k nearest with a cosine above 0, nearest first, ties to the lower number."""
        out = []
        for at in range(0, len(queries), QUERIES):
            some = queries[at : at + QUERIES]
            asked = np.zeros((len(some), len(self.table)))
            for i, (numbers, weights) in enumerate(some):
                rows = self.row[numbers]
                asked[i, rows[rows >= 0]] = weights[rows >= 0]
            scores = asked @ self.table
            tops = scores.reshape(len(some), self.blocks, BLOCK).max(axis=2)
            out += [self._visit(*query, scores[i], tops[i], k) for i, query in enumerate(some)]
        return out

    def _visit(self, numbers: np.ndarray, weights: np.ndarray, scores: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Adds the other terms' part to scores, in all blocks whose bound reaches the k-th best."""
        entry, weight = spread(self.entries[numbers], self.entries[numbers + 1], weights)
        block = self.block[entry]
        bounds = bounds + np.bincount(block, weight * self.top[entry], self.blocks)
        order, whole = np.argsort(-bounds, kind="stable"), np.zeros(self.blocks, bool)
        least, at, step = 0.0, 0, max(1, self.blocks // 8)
        while at < self.blocks and bounds[order[at]] > max(0.0, least - 1e-9):
            now = np.zeros(self.blocks, bool)
            now[order[at : at + step]] = True
            now &= bounds > max(0.0, least - 1e-9)
            chosen = now[block]
            posting, w = spread(self.start[entry[chosen]], self.start[entry[chosen] + 1], weight[chosen])
            scores += np.bincount(self.example[posting], w * self.weight[posting], len(scores))
            whole |= now
            done = np.where(np.repeat(whole, BLOCK), scores, 0.0)
            least = float(np.partition(done, -k)[-k]) if len(done) >= k else 0.0
            at, step = at + step, 8 * step
        if not whole.any():
            return []
        done = np.round(done, 12)
        hits = np.flatnonzero(done >= max(least - 1e-9, 1e-12))
        best = hits[np.lexsort((hits, -done[hits]))][:k]
        return list(zip(done[best].tolist(), best.tolist(), strict=True))


def spread(low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to high of each pair in a row, each with its pair's weight."""
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + sizes, sizes), np.repeat(weights, sizes)


class Voter:
    """Scores texts by the votes of their nearest examples (term numbers, counts, rows, toxic rows, doc_id)."""

    def __init__(self, terms: list[str], examples: list[tuple[np.ndarray, np.ndarray, int, int, int]], frequency: np.ndarray, documents: int):
        rows, bad = sum(e[2] for e in examples), sum(e[3] for e in examples)
        self.rate = bad / rows if rows else 0.0
        self.terms, self.reader = terms, None
        shares = [(e[0], e[3] / e[2]) for e in examples]
        self.term_weight = np.log((1 + documents) / (1 + frequency)) * gains(len(terms), shares, sum(s for _, s in shares) / max(1, len(shares)))
        vectors = [self.vector(e[0], e[1]) for e in examples]
        common = [tuple(at[np.argsort(-frequency[at], kind="stable")[:3]].tolist()) for at, _ in vectors]  # like examples get neighbouring numbers
        order = sorted((i for i, v in enumerate(vectors) if len(v[0])), key=lambda i: (common[i], examples[i][4], examples[i][0].tobytes(), examples[i][1].tobytes()))
        self.votes = [examples[i][2:] for i in order]
        self.index = BlockMaxIndex([vectors[i] for i in order], len(terms))
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order and their weights, of length one; empty without any that has a weight."""
        weights = (1 + np.log(counts)) * self.term_weight[numbers]
        numbers, weights = numbers[weights > 0], weights[weights > 0]
        return numbers, weights / np.sqrt((weights * weights).sum()) if len(numbers) else weights

    def _vote(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        weight = [(s * s / (1.0001 - min(s, 1.0)), self.votes[i]) for s, i in near]
        total, bad = sum(w * v[0] for w, v in weight), sum(w * v[1] for w, v in weight)
        return (bad + PRIOR * self.rate) / (total + PRIOR), [v[2] for _, v in weight]

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """Of each text the score, and the doc_ids of the examples that voted, nearest first."""
        import xxhash

        self.reader = self.reader or Numbers(self.terms)
        if len(self.known) > KEPT:
            self.known.clear()
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.known}
        vectors = [self.vector(*self.reader.counts(t)) for t in new.values()]
        self.known.update(zip(new, map(self._vote, self.index.nearest(vectors)), strict=True))
        return [self.known[key] for key in keys]


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, label: str = "toxic", rows: int = TRAIN_ROWS, terms: int = TRAIN_TERMS) -> Voter:
    """Learns from at most `rows` labelled rows with `terms` terms in all; what reaches the driver is bounded by that."""
    scratch = Scratch(spark, "toxicity")
    sample = labelled_sample(docs, labels, label, rows).groupBy("text").agg(F.count("*").alias("n"), F.sum("label").alias("bad"), F.min("doc_id").alias("doc_id"))

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            found = [(row, terms_of(row["text"])) for row in rows]
            return [(row["doc_id"], row["n"], row["bad"], len(c), "\n".join(c), np.array([*c.values()], np.int64).tobytes()) for row, c in found]

        return work

    counted = scratch.table(rowwise(sample, "doc_id long, n long, bad long, size long, terms string, counts binary", step), "examples")
    found = within(counted, "size", terms, F.xxhash64("doc_id", "terms"), "doc_id", "terms", "counts").collect()
    scratch.clear()
    split = [r["terms"].split("\n") if r["terms"] else [] for r in found]
    known = sorted(set(chain.from_iterable(split)))
    number = {t: i for i, t in enumerate(known)}
    examples = []
    for r, mine in zip(found, split, strict=True):
        numbers = np.array([number[t] for t in mine], np.int64)
        order = np.argsort(numbers)
        examples.append((numbers[order], np.frombuffer(r["counts"], np.int64)[order], r["n"], r["bad"], r["doc_id"]))
    frequency, documents = document_frequencies(docs, spark, known) if known else (np.zeros(0, np.int64), 0)
    return Voter(known, examples, frequency, documents)


def toxicity_scores(docs: DataFrame, labels: DataFrame, spark: SparkSession, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence (doc_ids of the examples that voted, nearest first).

    Every row is scored on its whole text; a null text is empty. A text without any term of a
    training text has no neighbours and scores the training rate; without training rows every score
    is 0. Of examples that are equally near those of the more like leading words, then of the smaller
    doc_id, vote. Rows that share a doc_id each have a row; a null doc_id is not held out. Other
    columns are not read. No rows: no rows.
    """
    shared = spark.sparkContext.broadcast(train(docs, labels, spark, label))

    def step():
        voter = shared.value

        def work(rows: list[dict]) -> list[tuple]:
            return [(row["doc_id"], *found) for row, found in zip(rows, voter.scores([r["text"] for r in rows]), strict=True)]

        return work

    scored = rowwise(texts_of(docs), "doc_id long, score double, evidence array<long>", step)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")
