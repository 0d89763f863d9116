"""Whole-text encoding with a public tokenizer, one dictionary look-up per word.

The tokenizer files used here never form a token across the border between a
character that is no blank and a blank, nor between a letter and one of a few marks.
So a text is cut at single blanks, each distinct piece is encoded once by the
library and remembered, and the ids of a text are the joined ids of its pieces.
A piece of plain letters skips the library's normaliser and splitter, whose outcome
is known for it, and goes to the library's model at once. Texts with unusual blanks
(anything but space, tab, line feed and carriage return) are encoded in one go.

Strings of special tokens inside a text count as ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

from quantaint.llm.batches import hold

_UNUSUAL_BLANK = re.compile(
    r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
)
_UNUSUAL_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
# With a space beside another blank, a text is cut before whole runs of blanks.
_RUNS = ("  ", " \n", "\n ", "\t", "\r")
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Marks that end a run of letters in every file and never start a contraction.
_MARKS = frozenset(".,;:!?|*#$%&")
# Each memory is emptied when it holds this many pieces; longer pieces are not kept.
_REMEMBERED = 600_000
_LONGEST = 48


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # How the file treats a plain letter, alone and after a space.
        split = self._tokenizer.pre_tokenizer.pre_tokenize_str
        normal = self._tokenizer.normalizer.normalize_str if self._tokenizer.normalizer else str
        letters = [chr(x) for x in range(256) if _PLAIN.fullmatch(chr(x))]
        self.shown = {ord(x): split(normal(x))[0][0] for x in letters}
        self.lowers = self.shown[ord("A")] == "a"
        space = split(normal(" a"))[0][0].removesuffix("a")
        self._drops_blanks = not space
        self._bare = _Memory(self, "", "", None)
        self._spaced = _Memory(self, " ", space, self._bare)

    @property
    def size(self) -> int:
        return self._tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text; none for a null or empty one."""
        if not text:
            return b""
        hold(self)
        if self._unusual(text):
            return self.general(text)
        for memory in (self._bare, self._spaced):
            if len(memory) > _REMEMBERED:
                memory.clear()
        if self._drops_blanks:
            return b"".join(map(self._bare.__getitem__, text.split()))
        if text[-1] == " " or any(run in text for run in _RUNS):
            return b"".join(map(self._bare.__getitem__, _PIECE.findall(text)))
        first, *rest = text.split(" ")
        return self._bare[first] + b"".join(map(self._spaced.__getitem__, rest))

    def clear(self) -> None:
        self._bare.clear()
        self._spaced.clear()

    @staticmethod
    def _unusual(text: str) -> bool:
        if text.isascii():
            return any(blank in text for blank in _UNUSUAL_ASCII)
        return _UNUSUAL_BLANK.search(text) is not None

    def general(self, text: str) -> bytes:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(found, dtype="<u4").tobytes()

    def model(self, shown: str) -> bytes:
        found = [t.id for t in self._tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)


class _Memory(dict):
    """Piece -> ids, where ``lead`` stands before the piece in the text."""

    def __init__(self, encoder: Encoder, lead: str, shown_lead: str, bare: _Memory | None):
        self._encoder, self._lead, self._shown_lead = encoder, lead, shown_lead
        self._bare = self if bare is None else bare

    def __missing__(self, piece: str) -> bytes:
        ids = self._find(piece)
        if len(piece) <= _LONGEST:
            self[piece] = ids
        return ids

    def _find(self, piece: str) -> bytes:
        if not piece:
            return self._encoder.general(self._lead) if self._lead else b""
        if piece.isascii() and piece.isalpha():
            shown = piece.lower() if self._encoder.lowers else piece
            return self._encoder.model(self._shown_lead + shown)
        if _PLAIN.fullmatch(piece):
            return self._encoder.model(self._shown_lead + piece.translate(self._encoder.shown))
        if piece[-1] in _MARKS and _PLAIN.fullmatch(piece, 0, len(piece) - 1):
            return self[piece[:-1]] + self._bare[piece[-1]]
        line = piece.find("\n")
        if line > 0 and not piece[line - 1].isspace():
            return self[piece[:line]] + self._bare[piece[line:]]
        if line == 0 and not self._lead and _PLAIN.match(piece, 1):
            return self._bare["\n"] + self._bare[piece[1:]]
        return self._encoder.general(self._lead + piece)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    return Encoder(path)


def token_bytes(token: int) -> bytes:
    return np.array([token], dtype="<u4").tobytes()
