"""Token ids and counts of whole texts, one word at a time.

Both vocabularies never merge across the start of a word that follows a space,
so a text is cut there, and the ids of a cut piece are kept for the next time
it occurs. The kept pieces are bounded; which are kept never changes a result.
"""

from __future__ import annotations

import json
import re

import tiktoken
from sentencepiece import SentencePieceProcessor

#: Pieces kept at most; then the memory starts afresh.
KEPT = 400_000

#: Fixed value: the pattern that byte-level vocabularies of this family split text with before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD_START = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?!\S)")
_SPACED = re.compile(r" *[^ ]+")


class _Memory(dict):
    """Results by piece, computed on first use."""

    def __init__(self, compute):
        super().__init__()
        self._compute = compute

    def __missing__(self, piece):
        if len(self) >= KEPT:
            self.clear()
        value = self[piece] = self._compute(piece)
        return value


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(256 + n)] = b
    return letters


class ByteBpe:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, without added special tokens.

    The strings of special tokens inside a text become their ids, as that
    library does by default. ``ids`` gives little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special
        }
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [ranks[bytes(letters[c] for c in a + b)] for a, b in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self._model = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self._memory = _Memory(self._encode)

    def _encode(self, piece: str) -> bytes:
        ids = self._model.encode(piece, allowed_special="all")
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return b"".join(map(self._memory.__getitem__, _WORD_START.split(text)))
        first, *rest = text.split(" ")
        return self._memory[first] + b"".join([self._memory[" " + w] for w in rest])


class PieceCounter:
    """Number of ids a ``sentencepiece`` model gives a text, without begin and end."""

    def __init__(self, path: str):
        self._model = SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        plain = self._model.encode("a b", out_type=str) == [mark + "a", mark + "b"]
        #: Words are independent if no piece has a space after another character.
        self._by_word = plain and not any(mark in p.lstrip(mark) for p in pieces)
        self._mark = mark
        self._memory = _Memory(self._count)

    def _count(self, text: str) -> int:
        return len(self._model.encode(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self._by_word or self._mark in text or text[-1] == " ":
            return self._count(text)
        if "  " in text or text[0] == " ":
            first, *rest = _SPACED.findall(text)
            return self._memory[first] + sum([self._memory[w[1:]] for w in rest])
        return sum(map(self._memory.__getitem__, text.split(" ")))
