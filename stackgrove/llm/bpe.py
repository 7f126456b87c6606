"""Byte-pair encoding by dynamic programming over prefixes, and decoding (operator 7).

The encoding of every prefix of a word ends in exactly one token, and a sequence of tokens is the
encoding of their text exactly if each neighbouring pair is the encoding of its own text. So one
pass suffices: a suffix automaton of the vocabulary gives the tokens that end at each place,
longest first; the one that goes with the last token of the prefix before it is stored; following
these back from the end gives the ids.

Symbols are the 256 bytes and the same 256 as the last byte of a word (a word-end suffix).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import rowwise, texts_of
from .encoding import CACHE, PRETOKEN, WORD_END, is_plain, vocabulary_path

END = 256


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class Tables:
    """What encoding needs of a vocabulary file, as arrays of a size fixed by the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.names = [""] * size
        for name, i in [*vocabulary.items(), *self.specials.items()]:
            self.names[i] = name
        self.symbol = np.full(2 * END, -1, np.int32)  # of each symbol its token
        spelled: dict[int, tuple[int, ...]] = {}
        for b, name in enumerate(byte_names()):
            for s, text in ((b, name), (END + b, name + WORD_END)):
                if text in vocabulary:
                    self.symbol[s] = vocabulary[text]
                    spelled[vocabulary[text]] = (s,)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank.setdefault((x, y), (rank, made))
            spelled.setdefault(made, spelled[x] + spelled[y])
        self.born = np.full(size, -1, np.int32)  # rank of the merge that makes a token
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.spelled = {}
        for token, symbols in spelled.items():
            ids, last = self.merged(symbols)
            if ids == [token]:  # else no text gives this token
                self.spelled[token] = symbols
                if last:
                    self.born[token], self.left[token], self.right[token] = last

    def merged(self, symbols: tuple[int, ...]) -> tuple[list[int], tuple[int, int, int] | None]:
        """The definition: the lowest-ranked pair merges first, from the left; and what merged last."""
        ids, last = [int(self.symbol[s]) for s in symbols], None
        while len(ids) > 1:
            rank, made = min((self.rank.get(p, (1 << 31, -1)) for p in zip(ids, ids[1:], strict=False)))
            if made < 0:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1]), (-1, -1))[0] == rank:
                    last = (rank, ids[i], ids[i + 1])
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids, last


class SuffixAutomaton:
    """All substrings of a set of strings; `ends[v]` has the strings that are v's own suffixes, longest first."""

    def __init__(self, strings: dict[int, tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for symbols in strings.values():
            last = 0
            for c in symbols:
                last = self._grow(last, c)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for name, symbols in strings.items():
            v = 0
            for c in symbols:
                v = self.next[v][c]
            self.ends[v].append((len(symbols), name))
        self.up = [0] * len(self.next)  # the next state on the way to the root that has strings of its own
        for v in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.ends[v].sort(reverse=True)
            at = self.link[v]
            self.up[v] = at if self.ends[at] or at == 0 else self.up[at]

    def _grow(self, last: int, c: int) -> int:
        if c in self.next[last]:
            to = self.next[last][c]
            return to if self.size[to] == self.size[last] + 1 else self._split(last, c, to)
        new = self._state({}, self.size[last] + 1)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            to = self.next[last][c]
            self.link[new] = to if self.size[to] == self.size[last] + 1 else self._split(last, c, to)
        return new

    def _state(self, edges: dict[int, int], size: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, v: int, c: int, to: int) -> int:
        new = self._state(dict(self.next[to]), self.size[v] + 1)
        self.link[new], self.link[to] = self.link[to], new
        while v >= 0 and self.next[v].get(c) == to:
            self.next[v][c] = new
            v = self.link[v]
        return new


class Model:
    """Encoder and decoder of one vocabulary; pickles as plain lists and dicts."""

    def __init__(self, path: str | None = None):
        tables = Tables(path or vocabulary_path())
        automaton = SuffixAutomaton(tables.spelled)
        self.names, self.specials = tables.names, tables.specials
        self.edges, self.link, self.size = automaton.next, automaton.link, automaton.size
        self.ends, self.up = automaton.ends, automaton.up
        self.rank = {p: r for p, (r, _) in tables.rank.items()}
        self.born, self.left, self.right = tables.born.tolist(), tables.left.tolist(), tables.right.tolist()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.path, self.front = path or vocabulary_path(), None

    def _front(self):
        """The file's normaliser and pre-tokenizer, for texts with characters beyond the plain ones."""
        if self.front is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)
            self.front = library.normalizer, library.pre_tokenizer, {name: b for b, name in enumerate(byte_names())}
        return self.front

    def __getstate__(self) -> dict:
        return self.__dict__ | {"front": None, "pairs": {}}

    def compatible(self, x: int, y: int) -> bool:
        """Whether the text of tokens x and y, encoded, is x and y.

        The merges that made x and y are undone from the last to the first. Where the tokens at
        the border could have merged before both were used up by their own merges, x and y don't
        stand. Of equal ranks the left merge is earlier.
        """
        key, gone_x, gone_y = (x, y), 1 << 31, 1 << 31
        if (known := self.pairs.get(key)) is not None:
            return known
        good = True
        while True:
            rank = self.rank.get((x, y))
            if rank is not None and rank < gone_x and rank <= gone_y:
                good = False
                break
            if self.born[x] > self.born[y]:
                gone_x, x = self.born[x], self.right[x]
            elif self.born[y] >= 0:
                gone_y, y = self.born[y], self.left[y]
            else:
                break
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [*raw[:-1], END + raw[-1]]
        last: list[tuple[int, int]] = [(0, -1)]  # of each prefix: the length and id of its last token
        edges, link, size, ends, up, compatible = self.edges, self.link, self.size, self.ends, self.up, self.compatible
        v = held = 0
        for i, c in enumerate(symbols, 1):
            while c not in edges[v]:
                v = link[v]
                held = size[v]
            v, held = edges[v][c], held + 1
            at, found = v, None
            while found is None:
                for n, token in ends[at]:
                    if n <= held and (n == i or compatible(last[i - n][1], token)):
                        found = (n, token)
                        break
                else:
                    if at == 0:
                        raise ValueError(f"no token ends at {i} of {raw!r}")
                    at = up[at]
            last.append(found)
        out, i = [], len(symbols)
        while i:
            n, token = last[i]
            out.append(token)
            i -= n
        return out[::-1]

    def pretokens(self, text: str) -> list[str | int]:
        """Pre-tokens of a text in order; special tokens as ids."""
        if is_plain(text, tuple(self.specials)):
            return PRETOKEN.findall(text.lower())
        out: list[str | int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                normal, split, byte = self._front()
                for name, _ in split.pre_tokenize_str(normal.normalize_str(part)):
                    out.append(bytes(map(byte.__getitem__, name)).decode())
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pretokens(text) for i in ([p] if isinstance(p, int) else self.word(p.encode()))]

    def decode(self, ids: list[int]) -> str:
        """Names of the tokens between spaces, special ones too: what a vocabulary without a decoder gives."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.cache
def model(path: str | None = None) -> Model:
    return Model(path)


class Digester:
    """Encodes each distinct pre-token once and keeps its ids and decoded form as text."""

    def __init__(self, of: Model):
        self.model = of
        self.cache: dict[str | int, tuple[int, bytes, bytes]] = {}

    def _entry(self, pretoken: str | int) -> tuple[int, bytes, bytes]:
        ids = [pretoken] if isinstance(pretoken, int) else self.model.word(pretoken.encode())
        return len(ids), " ".join(map(str, ids)).encode(), self.model.decode(ids).encode()

    def row(self, text: str) -> tuple[int, str, str]:
        pretokens = self.model.pretokens(text)
        found = list(map(self.cache.get, pretokens))
        if None in found:
            if len(self.cache) > CACHE // 2:
                self.cache.clear()
            for p in pretokens:
                if p not in self.cache:
                    self.cache[p] = self._entry(p)
            found = list(map(self.cache.__getitem__, pretokens))
        if not found:
            return 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()
        n, ids, names = zip(*found, strict=True)
        return sum(n), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(names)).hexdigest()


def encoded_digests(docs: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text is empty: no ids, and the digests of nothing. Rows that share a doc_id give a row
    each; other columns are not read. The broadcast model's size is fixed by the vocabulary.
    """
    shared = spark.sparkContext.broadcast(model(path))

    def step():
        digest = Digester(shared.value)

        def work(rows: list[dict]) -> list[tuple]:
            return [(row["doc_id"], *digest.row(row["text"])) for row in rows]

        return work

    return rowwise(texts_of(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", step)
