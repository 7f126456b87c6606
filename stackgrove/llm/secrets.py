"""Secrets in texts: candidate strings, and a random forest that drops false findings (operator 4).

Patterns find candidates in the whole text. The forest judges each by its length, the transitions
between kinds of characters, how much of it dictionary words cover, the path it comes from, and the
words around it. It is trained from labelled findings; `labelled_findings` makes a default set by rule.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
import string
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rowwise
from .encoding import WORD_END, vocabulary_path

#: Words that name a secret, words that name something else, and parts of paths of samples.
NAMES = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key"]
OTHERS = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "version", "id", "ref", "example", "placeholder", "sample", "dummy", "changeme", "image", "href", "src", "http", "https", "order", "invoice", "phone", "card", "isbn"]
SAMPLES = ["test", "tests", "example", "examples", "doc", "docs", "fixture", "fixtures", "sample", "mock"]
#: A run of characters that keys and tokens are made of; a candidate has a digit or stands after a name of a secret.
RUN = re.compile(r"[A-Za-z0-9_\-+/=.~]{8,}")
#: What keys of known services begin with.
PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[_-]|pk_live|rk_live|AIza|eyJ|-----BEGIN|glpat-|npm_")
#: A private key with whatever header lines it has.
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
NAMED = re.compile(r"(?i)(" + "|".join(map(re.escape, NAMES)) + r")[\w\-]{0,20}[\"']?\s*[:=]{1,2}>?\s*[\"']?$")
#: The whole value that a name of a secret is given, of any signs: quoted, or up to a blank.
VALUE = re.compile(r"(?i)(?:" + "|".join(map(re.escape, NAMES)) + r")[\w\-]{0,20}[\"']?\s*[:=]{1,2}>?\s*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))")
#: The password of a URL.
URL = re.compile(r"://[^\s/:@]+:([^\s/@]{4,})@")
#: Characters read before and after a candidate.
AROUND = 48
KINDS = 5
FEATURES = KINDS * KINDS + 16
TREES, DEPTH, LEAST_LEAF, SEED, THRESHOLD = 40, 10, 3, 5, 0.5
REPLACEMENT = "[SECRET]"


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    value: str
    before: str
    after: str


def candidates(text: str) -> list[Finding]:
    """Strings of the text that may be secrets, in order, without overlap."""
    low, found, taken = text.lower(), [], bytearray()

    def take(a: int, b: int) -> None:
        taken.extend(bytes(len(text) - len(taken)))
        if 1 not in taken[a:b]:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b))

    for m in BLOCK.finditer(text) if "-----BEGIN" in text else ():
        take(*m.span())
    for m in URL.finditer(text) if "://" in text and "@" in text else ():
        take(*m.span(1))
    for m in VALUE.finditer(text) if any(name in low for name in NAMES) else ():
        a, b = m.span(m.lastindex)
        take(a, b if m.lastindex < 3 else a + len(m.group(3).rstrip(".:!?)]")))
    for m in RUN.finditer(text):
        a, b = m.span()
        value = m.group().rstrip(".")
        b = a + len(value)
        if 1 in taken[a:b]:
            continue
        head, sign, tail = value.rpartition("=")
        if sign and tail and re.search("(?i)" + "|".join(map(re.escape, NAMES)), head):
            a, value = a + len(head) + 1, tail  # name=value in one run
        if len(value) < 8:
            continue
        named = NAMED.search(text[max(0, a - AROUND) : a])
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if named or (len(value) >= 16 and (mixed or PREFIX.match(value))):
            found.append((a, b))
    return [Finding(a, b, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]) for a, b in sorted(found)]


@functools.cache
def dictionary(path: str | None = None) -> frozenset[str]:
    """Whole words of four letters or more in the tokenizer's vocabulary."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    return frozenset(w for n in names if n.endswith(WORD_END) and len(w := n.removesuffix(WORD_END)) >= 4 and w.isascii() and w.isalpha())


def covered(value: str) -> float:
    """Share of the characters within dictionary words, longest first from the left."""
    low, words, at, n = value.lower(), dictionary(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(14, len(low) - at), 3, -1) if low[at : at + k] in words), 0)
        n += size
        at += size or 1
    return n / max(1, len(low))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "+/=_-." else 4


def features(finding: Finding, path: str) -> list[float]:
    v = finding.value
    kinds = [_kind(c) for c in v]
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    n = len(v)
    out = [moves[a, b] / max(1, n - 1) for a in range(KINDS) for b in range(KINDS)]
    counts = Counter(v)
    before, after = (re.findall(r"[a-z0-9_\-]+", s.lower()) for s in (finding.before, finding.after))
    near, parts = before[-3:], re.findall(r"[a-z]+", path.lower())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    out += [
        math.log(len(finding.value)),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        changes / max(1, n - 1),
        covered(v),
        float(all(c in string.hexdigits for c in v)),
        float(v.isdigit()),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v) is not None),
        float(PREFIX.match(v) is not None),
        float(NAMED.search(finding.before) is not None),
        float(bool(near) and any(name in near[-1] for name in NAMES)),
        float(any(w in OTHERS for w in near)),
        float(any(w in OTHERS for w in after[:2])),
        float(finding.before[-1:] in "\"'"),
        float(any(p in SAMPLES for p in parts)),
        float(re.search(r"(?i)example|changeme|x{4}|\.{3}|your|1234567", v) is not None),
    ]
    return out


class Forest:
    """Trees of threshold splits on random features over samples drawn with replacement; Gini impurity."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.nodes: list[list[tuple[int, float, int, int, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = r.integers(0, len(x), len(x))
            tree: list = []
            self._grow(tree, x[rows], y[rows], self.depth, r)
            self.nodes.append(tree)
        return self

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator) -> int:
        place = len(tree)
        share = float(y.mean())
        tree.append((-1, 0.0, 0, 0, share))
        if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
            return place
        best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
        for f in r.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False).tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, sums = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= LEAST_LEAF) & (cut <= len(y) - LEAST_LEAF)]
            if len(cut):
                left = sums[cut - 1] / cut
                right = (sums[-1] - sums[cut - 1]) / (len(y) - cut)
                impurity = (cut * 2 * left * (1 - left) + (len(y) - cut) * 2 * right * (1 - right)) / len(y)
                k = int(np.argmin(impurity))
                if impurity[k] < best[0]:
                    best = (float(impurity[k]), f, float((v[cut[k]] + v[cut[k] - 1]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] < best[2]
            a = self._grow(tree, x[low], y[low], depth - 1, r)
            b = self._grow(tree, x[~low], y[~low], depth - 1, r)
            tree[place] = (best[1], best[2], a, b, share)
        return place

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.nodes:
            f, at, low, high, share = tree[0]
            while f >= 0:
                f, at, low, high, share = tree[low if row[f] < at else high]
            total += share
        return total / len(self.nodes)


def labelled_findings(n: int = 4000, seed: int = SEED) -> list[tuple[str, str, int]]:
    """Contexts with one candidate each as (text, path, whether it is a secret), half and half.

    The shapes are those of published key formats and of usual configuration files.
    """
    r = np.random.default_rng(seed)
    words = sorted(dictionary())

    def pick(chars: str, size: int) -> str:
        return "".join(chars[i] for i in r.integers(0, len(chars), size))

    def one(options: list) -> str:
        return options[int(r.integers(len(options)))]

    def prose() -> str:
        return " ".join(one(words) for _ in range(int(r.integers(2, 7))))

    hexes, alnum = string.digits + "abcdef", string.ascii_letters + string.digits
    assign = ["{n}={v}", "{n} = {v}", '{n}: "{v}"', '{n} = "{v}"', "{n}: {v}", "{n}='{v}'"]
    secrets = [
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum + "_-", 40),
        lambda: one(assign).format(n=one(NAMES), v=pick(hexes, int(r.integers(16, 65)))),
        lambda: one(assign).format(n=one(NAMES), v=pick(alnum, int(r.integers(12, 48)))),
        lambda: one(assign).format(n=one(NAMES), v=pick(hexes, int(r.integers(16, 20)))),
        lambda: one(assign).format(n=one(NAMES), v=base64.b64encode(r.bytes(int(r.integers(18, 40)))).decode()),
        lambda: one(assign).format(n=one(NAMES[:3]), v=one(words) + pick(string.digits, int(r.integers(1, 5)))),
        lambda: one(assign).format(n=one(NAMES[:3]), v=one(words) + one(words) + one(["", "!", "1"])),
        lambda: one(assign).format(n=one(NAMES[:4]), v=one(words).capitalize() + pick("!@#$%&*?", int(r.integers(1, 3))) + pick(alnum, int(r.integers(3, 9)))),
        lambda: one(["postgres", "https", "mysql", "amqp"]) + "://" + one(words) + ":" + one(words) + pick(alnum, 5) + "@" + one(words) + ".com/" + one(words),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + one(["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + pick(hexes.upper(), 32) + "\n\n"]) + base64.b64encode(r.bytes(200)).decode() + "\n-----END RSA PRIVATE KEY-----",
    ]
    others = [
        lambda: one(OTHERS[:6]) + " " + pick(hexes, one([32, 40, 64])),
        lambda: one(["sha256:", "md5:", "commit "]) + pick(hexes, one([32, 40, 64])),
        lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: "_".join(one(words) for _ in range(3)) + str(r.integers(1000)),
        lambda: "/".join(one(words) for _ in range(4)) + "/" + str(r.integers(10000)),
        lambda: one(words).capitalize() + one(words).capitalize() + one(words).capitalize() + str(r.integers(100)),
        lambda: one(assign).format(n=one(NAMES), v=one(["changeme", "your-token-here", "xxxxxxxxxxxx", "example-password", "<password>", "placeholder1234", "********", "$" + "{" + one(words).upper() + "}", "os.environ['" + one(words).upper() + "']", "process.env." + one(words).upper(), "required", "string"])),
        lambda: one(["https", "postgres"]) + "://" + one(["user", "username"]) + ":" + one(["password", "<password>", "$" + "{PASSWORD}"]) + "@" + one(["localhost", "host", "example.com"]) + "/" + one(words),
        lambda: one(assign).format(n=one(NAMES[3:]), v="_".join(one(words) for _ in range(3))),
        lambda: one(assign).format(n=one(NAMES[3:]), v=one(words)),
        lambda: one(words) + "." + one(words) + "." + pick(string.digits, 2) + "-" + one(words) + ".com",
        lambda: "v" + ".".join(str(r.integers(100)) for _ in range(3)) + "-" + one(words) + pick(string.digits, 8),
        lambda: "https://" + one(words) + ".org/" + one(words) + "/" + pick(string.digits, 8) + "?" + one(words) + "=" + pick(hexes, 8),
        lambda: one(words) + pick(string.digits, 3) + "-" + one(words) + pick(string.digits, 4),
    ]
    out = []
    for k in range(n):
        secret = k % 2
        part = one(secrets if secret else others)()
        path = one(["src", "config", "app", "web", ""] if secret or r.random() < 0.6 else SAMPLES)
        out.append((f"{prose()} {part} {prose()}", path, secret))
    return out


def train(findings: Iterable[tuple[str, str, int]] | None = None) -> Forest:
    """A forest from (text, path, label) findings; a text's label holds for every candidate in it."""
    rows, labels = [], []
    for text, path, label in labelled_findings() if findings is None else findings:
        for c in candidates(text):
            rows.append(features(c, path))
            labels.append(label)
    return Forest().fit(np.array(rows), np.array(labels, float))


@functools.cache
def default_forest() -> Forest:
    return train()


def secrets_in(text: str, path: str, forest: Forest, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """start, end and score of each finding that the forest lets stand."""
    judged = ((c.start, c.end, forest.score(features(c, path))) for c in candidates(text))
    return [x for x in judged if x[2] >= threshold]


def secret_findings(docs: DataFrame, spark: SparkSession, path_col: str = "source", forest: Forest | None = None) -> DataFrame:
    """doc_id, start, end (code points of the whole text), value_sha256, score: a row for each secret.

    Null and empty texts and those without secrets give no rows; a null path is an empty one. A text or a
    value of any length is read whole. Rows that share a doc_id are scanned each. Values are given as digests
    only. Other columns are not read. No rows: no rows.
    """
    shared = spark.sparkContext.broadcast(forest or default_forest())

    def step():
        judge = shared.value

        def work(rows: list[dict]) -> list[tuple]:
            return [(r["doc_id"], a, b, r["text"][a:b], s) for r in rows for a, b, s in secrets_in(r["text"] or "", r["path"] or "", judge)]

        return work

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    found = rowwise(rows, "doc_id long, start int, end int, value string, score double", step)
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score")


def redact(text: str | None, path: str | None, forest: Forest) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in secrets_in(text, path or "", forest):
        out += [text[at:a], REPLACEMENT]
        at = b
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, spark: SparkSession, path_col: str = "source", forest: Forest | None = None) -> DataFrame:
    """docs with each secret in `text` replaced; all rows and columns stay, a null text stays null."""
    shared = spark.sparkContext.broadcast(forest or default_forest())

    @F.pandas_udf("string")
    def clean(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([redact(None if t is None or t != t else t, None if p is None or p != p else p, shared.value) for t, p in zip(text, path, strict=True)], dtype=object)

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    return docs.select(*[clean(F.col("text").cast("string"), path).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
