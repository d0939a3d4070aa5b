"""Byte-level BPE ids of whole texts with the tokenizers library, fast on repeated words.

A text is cut before every space and on both sides of every line end. Where no two white-space characters touch, the
byte-level pre-tokenizer never joins text across such a cut, so the ids of a text are the ids of its pieces in order, and
each piece is encoded once and kept. Texts with two white-space characters in a row are encoded whole. The kept pieces are
bounded in number, by ``KEPT``, and so is a worker's memory.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from string import ascii_letters

import regex

from ._shared import keeps, task_of

KEPT = 500_000
END = 0  # the id that ends a document
#: Fixed: how the byte-level pre-tokenizer of the public vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TWO = re.compile(r"\s\s")
#: Signs of white space that isn't single spaces and line ends between words.
_UNUSUAL = ("  ", "\n\n", " \n", "\n ", *(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
_SPLIT = regex.compile(PATTERN)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids by text. When it is full, it becomes the old generation, from which entries in use come back."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        self[text] = ids
        return ids


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids, without an end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.bytes = self.tokenizer.model.tokenize, byte_letters()
        self.letters = {c: "".join(self.bytes[b] for b in chr(c).encode()) for c in range(0x250)}
        self.starts, self.marks = frozenset(" " + ascii_letters), {m: self._part(m) for m in ".,;:!?"}
        self.line = self._part("\n")
        self.parts = _Kept(self._part, KEPT // 4)
        self.first, self.rest = _Kept(self._piece, KEPT // 8), _Kept(lambda t: self._piece(" " + t))

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if text.isascii() and text.isprintable():
            written = text.replace(" ", self.bytes[32])
        elif text.isascii() or max(text) < "\u0250":
            written = text.translate(self.letters)
        else:
            written = "".join([self.bytes[b] for b in text.encode()])
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def _piece(self, text: str) -> bytes:
        word = text[1:]
        if word.isalpha() and text[0] in self.starts:
            return self._part(text)
        if (mark := self.marks.get(text[-1:])) and text[1:-1].isalpha() and text[0] in self.starts:
            return (self.rest[text[1:-1]] if text[0] == " " else self.first[text[:-1]]) + mark
        if "|" in text:  # may name a special token
            return self.plain(text)
        return b"".join(map(self.parts.__getitem__, _SPLIT.findall(text)))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(map(text.__contains__, _UNUSUAL)) and _TWO.search(text):
            return self.plain(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(b"".join([self.first[head] if head else b"", *map(self.rest.__getitem__, rest)]))
        return self.line.join(out)


_ENCODERS: dict[str, Encoder] = {}
keeps("tokens", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    task_of("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
