"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

A byte-pair encoder works on each pre-token alone, so the ids of a text are those of its
pre-tokens in a row. Texts of characters whose normal form, case mapping and class are plain
(below U+0180, without U+0130) are cut here; any other text, and any that holds a special token,
goes to the library whole.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

import numpy as np

ODD = re.compile("[^\x00-įı-ſ]")
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
LETTERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
#: The contractions the vocabulary's pre-tokenizer splits off.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
PRETOKEN = re.compile(f"{'|'.join(CONTRACTIONS)}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: The suffix that marks the last token of a pre-token in this vocabulary.
WORD_END = "</w>"
#: Pre-tokens kept in a worker; beyond that it starts anew.
CACHE = 400_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_plain(text: str, specials: tuple[str, ...]) -> bool:
    return (text.isascii() or not ODD.search(text)) and not any(s in text for s in specials)


class Encoder:
    """ids(text): the little-endian unsigned 32-bit token ids of the whole text, as bytes."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        names = self.library.get_vocab()
        self.ending = np.zeros(max(names.values()) + 1, bool)
        self.ending[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token from one call: only the last token of a pre-token ends a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words):
            return [self.whole(w) for w in words]
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def ids(self, text: str) -> bytes:
        if not is_plain(text, self.specials):
            return self.whole(text)
        words = PRETOKEN.findall(text.lower())
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = list({w for w in words if w not in self.cache})
            self.cache.update(zip(new, self.each(new), strict=True))
            found = map(self.cache.__getitem__, words)
        return b"".join(found)


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
