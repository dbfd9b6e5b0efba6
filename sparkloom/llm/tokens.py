"""Token ids of whole texts, as the ``tokenizers`` library gives them.

The library's model is asked for the ids of words; a text's ids are those of its words
in order, so each distinct short word is encoded once per worker and kept in a cache of
bounded size. Texts with characters beyond Latin-1, or with what may be a special
token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

#: Words that a worker keeps before its cache starts anew, and how long such a word may be.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64

#: Texts of these characters only can be cut into words here.
_PLAIN = re.compile(r"[\x09-\x0D -~À-ÖØ-öø-ÿ]*")
#: The vocabulary files' own word patterns (fixed values), for those characters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
_SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")

#: Byte-level BPE names a byte by a visible character: its own, or for the 68 bytes
#: that have none the next free one from U+0100.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_NAMES = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_NAMES = [_BYTE_NAMES.get(b, chr(b)) for b in range(256)]


def _named(word: str) -> str:
    """A word's bytes by their names; visible ASCII after at most one space, the usual case, is named as a whole."""
    spaced = word[0] == " "
    rest = word[1:] if spaced else word
    if rest.isascii() and rest.isprintable() and " " not in rest:
        return _NAMES[32] + rest if spaced else rest
    return "".join(map(_NAMES.__getitem__, word.encode()))


class _Words(dict):
    """Ids of words as bytes; a word that is not here is encoded and, if short, kept."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids by one of the two ``.json`` vocabularies; ``spaced`` says that words keep the space before them.

    Without it the vocabulary lower-cases and drops white space.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._spaced = spaced
        self._known = _Words(self._word)

    def _word(self, word: str) -> bytes:
        return array("H", [t.id for t in self._model.tokenize(_named(word))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as 16-bit integers; null and empty texts have none.

        Special strings inside a text are special tokens, the library's default.
        """
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return array("H", self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        words = _SPACED.findall(text) if self._spaced else _WORDS.findall(text.lower())
        return b"".join(map(self._known.__getitem__, words))


@cache
def byte_level(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, spaced=True)


@cache
def word_level(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, spaced=False)
