"""Exact whole-text tokenisation through bounded caches of pre-tokens.

A text is cut only where the tokeniser itself can never join two sides, so the
ids of the parts, put end to end, are the ids of the whole.  Cutting at single
spaces is the fast way; a text in which that could differ (runs of white space)
takes a pattern that follows the tokeniser's own rule, and a text that holds a
special string of the vocabulary goes to the library whole.  Each distinct part
is tokenised once while it stays in the cache.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import Counter
from operator import mul

import numpy as np

#: Unicode White_Space, as the tokenisers' pattern ``\s`` has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most entries of a worker's cache; a full cache starts anew.
CACHE_ENTRIES = 600_000

#: Byte-level rule: one space belongs to the word after it, other white space to itself.
BYTE_LEVEL_PARTS = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
#: Pieces carry spaces in front only and never a line feed.
PIECE_PARTS = re.compile(r" *[^ \n]+| +|\n")
#: Words of plain letters and signs, for which the tokeniser's own cuts are certain.
LETTERS, SIGNS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-&(-/:-@\[-^`{-~]*"
PLAIN_WORD = re.compile(rf"( ?{LETTERS})({SIGNS})(?:(\n)({LETTERS})({SIGNS}))?")


class Cache(dict):
    """key -> value, made on first use; starts anew when full."""

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stays, the other bytes follow from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class IdEncoder:
    """Whole texts to little-endian unsigned 32-bit ids, equal to the library's."""

    def __init__(self, name: str, limit: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.library.model
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.drops_space = self.library.normalizer is not None
        self.alphabet = _printable_bytes()
        self.latin = {i: "".join(self.alphabet[b] for b in chr(i).encode()) for i in range(256)}
        self.pre = Cache(self._pre, limit // 2)
        self.words = Cache(self._word, limit)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _pre(self, pre_token: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(pre_token.translate(self.latin))]).tobytes()

    def _part(self, part: str) -> bytes:
        found = PLAIN_WORD.fullmatch(part)
        if not found:
            return self.whole(part)
        if self.drops_space:
            return b"".join(self.pre[x.lower()] for x in found.groups() if x and x != "\n")
        return b"".join(self.pre[x] for x in found.groups() if x)

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and the word; None where white space meets white space."""
        if self.drops_space:
            return self._part(word) if word else b""
        return None if not word or word[0] in WHITE_SPACE else self._part(" " + word)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if not text:
            return b""
        words, get = text.split(" "), self.words.__getitem__
        first = words[0]
        if self.drops_space:
            return b"".join(map(get, words))
        words[0] = ""
        del words[0]
        try:
            return (self._part(first) if first else b"") + b"".join(map(get, words))
        except TypeError:  # a None: runs of white space
            return b"".join(self.pre_parts(text))

    def pre_parts(self, text: str):
        for part in BYTE_LEVEL_PARTS.findall(text):
            yield self.words[part[1:]] if len(part) > 1 and part[0] == " " and part[1] not in WHITE_SPACE else self._part(part)


class PieceCounter:
    """Pre-tokens of whole texts, and the number of pieces of each.

    A pre-token's key is what follows its one leading space; one that begins
    otherwise has its own text after a space as its key.
    """

    #: Put before a pre-token so that no prefix space is added to it.
    GUARD = "\n"

    def __init__(self, name: str, limit: int = CACHE_ENTRIES):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any("\n" in x or re.search("[^▁]▁", x) for x in pieces):
            raise ValueError("this vocabulary joins pieces across the pre-token boundaries")
        self.guard = len(self.library.encode(self.GUARD))
        self.parts = Cache(self._part, limit)

    def _part(self, part: str) -> int:
        return len(self.library.encode(self.GUARD + part)) - self.guard

    def pieces(self, key: str) -> int:
        if key[0] == " ":
            return self._part(key[1:])
        if "\n" in key:
            return sum(self.parts[x] for x in PIECE_PARTS.findall(" " + key))
        return self._part(" " + key)

    def count(self, text: str) -> int:
        return sum(n * self.pieces(key) for key, n in Counter(piece_keys(text)).items())


def piece_keys(text: str) -> list[str]:
    """The keys of a text's pre-tokens, in order."""
    if not text:
        return []
    text = text.replace("▁", " ")
    keys = text.split(" ")  # the library puts a space before the first word too
    if "" not in keys:
        return keys
    # runs of spaces
    return [x[1:] if x[0] == " " and len(x) > 1 and x[1] != " " else " " + x for x in PIECE_PARTS.findall(" " + text)]


@functools.lru_cache(maxsize=2)
def id_encoder(name: str) -> IdEncoder:
    return IdEncoder(name)


@functools.lru_cache(maxsize=1)
def piece_counter(name: str) -> PieceCounter:
    return PieceCounter(name)
