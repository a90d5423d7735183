"""Exact ids of the tokenizers library for whole texts, with words looked up instead of encoded again.

The pre-tokenizers of the public vocabularies never let a token run from a character that is not
white space into white space. A text whose words are parted by single spaces and line ends is
therefore the concatenation of its words' ids, and words repeat. Any other text goes to the library
as it is, as does one that holds an added token such as <|endoftext|>.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

END_OF_TEXT = {"byte_bpe_50k.json": 2, "word_bpe_49k.json": 1}

# Letters of Latin-1 and punctuation that is neither a quote nor a bracket.
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%$&#|]*)")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory(dict):
    """Computed values of the last ``size`` to twice ``size`` keys."""

    def __init__(self, compute: Callable[[str], bytes], size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to ``encode(text)`` of the library.

    ``keeps_space`` tells whether the vocabulary has tokens for white space. Strings of special
    tokens inside a text become those tokens, as by default. Null is the empty text.
    """

    def __init__(self, name: str, remembered: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.keeps_space = bool(self._whole(" "))
        self.lowers = self._whole("A") == self._whole("a")
        self.pieces = _Memory(self._piece, remembered)
        self.starting = _Memory(lambda w: self._word(w, ""), remembered)
        self.following = _Memory(lambda w: self._word(w, " "), remembered) if self.keeps_space else self.starting
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.lowers:
            piece = piece.lower()
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str, before: str) -> bytes:
        plain = _PLAIN_WORD.fullmatch(word)
        if plain is None:
            return self._whole(before + word)
        ids = self.pieces[before + plain[1]]
        return ids + self.pieces[plain[2]] if plain[2] else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        lines = text.split("\n")
        if text.split() != text.replace("\n", " ").split(" ") or any(t in text for t in self.added):
            return self._whole(text)
        out = []
        for line in lines:
            first, *rest = line.split(" ")
            out.append(self.starting[first] + b"".join(map(self.following.__getitem__, rest)))
        return self.line_end.join(out)


_encoders: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """One encoder per worker process."""
    if name not in _encoders:
        _encoders[name] = TextEncoder(name)
    return _encoders[name]


def encoded(texts: Iterator, name: str, end: int) -> Iterator[bytes]:
    """Ids of each text, with the id ``end`` after it."""
    encode, last = encoder(name).encode, np.array([end], "<u4").tobytes()
    for text in texts:
        yield encode(text) + last
