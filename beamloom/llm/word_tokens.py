"""Ids of whole texts in a BPE vocabulary of lower-case words, with the tokenizers library, fast on repeated words.

The vocabulary's normalizer turns white space into spaces and its pre-tokenizer never takes a space into a token, so the
ids of a text are those of its parts between spaces and line ends, in order. Each part is encoded once and kept; the
number of kept parts is bounded by ``KEPT``. Parts with white space of other kinds inside are encoded as they are.
"""

from __future__ import annotations

import os
from array import array

from ._shared import keeps, task_of
from .tokens import KEPT, _Kept, byte_letters

#: Fixed: how the vocabulary's byte-level step writes a character, after lower-casing. Plain letters go this short way.
_MARKS = ".,;:!?"


class WordEncoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids, without an end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, letters = self.tokenizer.model.tokenize, byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).lower().encode()) for c in range(0x100)}
        self.marks = {m: self.plain(m) for m in _MARKS}
        self.kept = _Kept(self._part, KEPT)

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word.translate(self.letters))]).tobytes()

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if part.isascii() or max(part) < "Ā":
            if part.isalpha():
                return self._word(part)
            if (mark := self.marks.get(part[-1])) and part[:-1].isalpha():
                return self._word(part[:-1]) + mark
        return self.plain(part)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}
keeps("word_tokens", _ENCODERS.clear)


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    task_of("word_tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
