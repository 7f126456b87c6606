"""Document quality by attention-based multiple-instance learning (operator 9).

A document is a bag of passages of PASSAGE words. Each passage is encoded by what kinds of
characters follow each other and how its words repeat; gated attention weighs the passages, and the
weighted mean of their codes gives the document's score. Only documents carry labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, rowwise, texts_of

PASSAGE, CODE, GATE = 40, 24, 16
#: Labelled rows that training takes, and passages in all of them at most; a row is taken whole or not at all.
TRAIN_ROWS, TRAIN_PASSAGES = 4000, 100_000
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 128, 0.01, 1e-4, 7
THRESHOLD = 0.7
#: Kinds of bytes: lower and upper case, digit, space, sentence mark, other sign, beyond ASCII.
KINDS = 7
_KIND = np.full(256, 5, np.int64)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[[ord(c) for c in ".,;:?'"]], _KIND[128:] = 3, 4, 6
FEATURES = KINDS * KINDS + 5


def passages(text: str) -> np.ndarray:
    """A row of FEATURES for each passage; one of zeros for a text without words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-n // PASSAGE)
    at = np.arange(0, n, PASSAGE)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    sizes = np.add.reduceat(lengths, at)
    kinds = _KIND[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
    pairs = np.repeat(np.arange(count) * (KINDS * KINDS), sizes)
    pairs[:-1] += kinds[:-1] * KINDS + kinds[1:]
    pairs[-1] += kinds[-1] * KINDS + 3
    out = np.empty((count, FEATURES), np.float32)
    out[:, : KINDS * KINDS] = np.bincount(pairs, minlength=count * KINDS * KINDS).reshape(count, -1) / sizes[:, None]
    same = np.fromiter((a == b for a, b in zip(words, [None, *words[:-1]], strict=True)), np.float64, n)
    members = np.diff(np.append(at, n))
    out[:, -5] = np.add.reduceat(same, at) / members
    out[:, -4] = [1 - len(set(words[i : i + PASSAGE])) / k for i, k in zip(at.tolist(), members.tolist(), strict=True)]
    out[:, -3] = sizes / members / 10
    out[:, -2] = members / PASSAGE
    out[:, -1] = 1
    return out


class AttentionModel:
    """Encoder, gated attention and classifier; trained by Adam on whole bags."""

    def __init__(self, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = {
            "encode": r.normal(0, features**-0.5, (features, CODE)),
            "value": r.normal(0, CODE**-0.5, (CODE, GATE)),
            "gate": r.normal(0, CODE**-0.5, (CODE, GATE)),
            "weigh": r.normal(0, GATE**-0.5, GATE),
            "out": r.normal(0, CODE**-0.5, CODE),
            "bias": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.w
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        z = np.tanh(x @ w["encode"])
        t, s = np.tanh(z @ w["value"]), 1 / (1 + np.exp(-(z @ w["gate"])))
        e = (t * s) @ w["weigh"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        h = np.add.reduceat(a[:, None] * z, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(h @ w["out"] + w["bias"][0], -40, 40)))
        return score, (bag, z, t, s, a, h)

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags, and the attention of all their passages in a row."""
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.cumsum([0, *map(len, bags[:-1])])
        score, kept = self._forward(x, starts)
        return score, kept[4]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> AttentionModel:
        x = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        r = np.random.default_rng(SEED)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)), None, 0
        first, second = first
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 100
            for at in range(0, len(bags), BATCH):
                chosen = order[at : at + BATCH]
                some = [bags[i] for i in chosen]
                gradient = self._gradient(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])]), labels[chosen])
                step += 1
                for k, g in gradient.items():
                    g = g + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        score, (bag, z, t, s, a, h) = self._forward(x, starts)
        miss = (score - labels) / len(labels)
        towards = np.outer(miss, w["out"])[bag]
        by_weight = (z * towards).sum(axis=1)
        by_energy = a * (by_weight - np.add.reduceat(a * by_weight, starts)[bag])
        by_gate = np.outer(by_energy, w["weigh"])
        by_t, by_s = by_gate * s * (1 - t * t), by_gate * t * s * (1 - s)
        by_z = a[:, None] * towards + by_t @ w["value"].T + by_s @ w["gate"].T
        return {"encode": x.T @ (by_z * (1 - z * z)), "value": z.T @ by_t, "gate": z.T @ by_s, "weigh": (t * s).T @ by_energy, "out": h.T @ miss, "bias": np.array([miss.sum()])}


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the crc32 of its id as text is 2 mod 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most `rows` training rows, those of the smallest hashes of their ids.

    Of several labels of an id the largest holds. The chosen labels are bounded by `rows` and so may be
    broadcast to find their texts; ids that many texts share are bounded after that once more.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = texts_of(docs).join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(rows)


def within(rows: DataFrame, size: str, most: int, *order: Column | str) -> DataFrame:
    """The first rows in that order whose `size` sums up to `most`, one at least; for tables whose rows a parameter bounds."""
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_total", total).filter((F.col("_total") <= most) | (F.col("_total") == F.col(size))).drop("_total")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most: int = TRAIN_PASSAGES) -> AttentionModel | None:
    """The model from at most `rows` labelled rows with `most` passages in all, or None where no labelled row is left to learn from."""

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            found = [(row, passages(row["text"])) for row in rows]
            return [(row["doc_id"], row["label"], len(x), x.astype("<f4").tobytes()) for row, x in found]

        return work

    scratch = Scratch(docs.sparkSession, "quality")
    bags = scratch.table(rowwise(labelled_sample(docs, labels, label, rows), "doc_id long, label int, size long, x binary", step), "bags")
    found = within(bags, "size", most, F.xxhash64("doc_id"), "doc_id", "x").collect()
    scratch.clear()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(np.float64) for r in found]
    return AttentionModel().fit(bags, np.array([r["label"] for r in found], float))


def quality_scores(docs: DataFrame, labels: DataFrame, spark: SparkSession, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, passages, and the passage that weighs most.

    Every row is scored on its whole text; a null text is empty, an empty one a passage of zeros.
    Rows that share a doc_id each have a row; a null doc_id is not held out. Without training rows every score is 1.
    """
    shared = spark.sparkContext.broadcast(train(docs, labels, label))

    def step():
        model = shared.value

        def work(rows: list[dict]) -> list[tuple]:
            bags = [passages(row["text"]) for row in rows]
            if model is None:
                return [(row["doc_id"], 1.0, len(b), 0) for row, b in zip(rows, bags, strict=True)]
            scores, attention = model.score(bags)
            out, at = [], 0
            for row, bag, score in zip(rows, bags, scores.tolist(), strict=True):
                out.append((row["doc_id"], score, len(bag), int(np.argmax(attention[at : at + len(bag)]))))
                at += len(bag)
            return out

        return work

    scored = rowwise(texts_of(docs), "doc_id long, score double, passages int, top_passage int", step)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "passages", "top_passage")


def accepted(docs: DataFrame, labels: DataFrame, spark: SparkSession, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `threshold`."""
    shared = spark.sparkContext.broadcast(train(docs, labels, label))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        model, out = shared.value, []
        for at in range(0, len(text), 64):
            bags = [passages(t if isinstance(t, str) else "") for t in text[at : at + 64]]
            out += [1.0] * len(bags) if model is None else model.score(bags)[0].tolist()
        return pd.Series(out, dtype=float)

    return docs.filter(score(F.col("text").cast("string")) >= threshold)
