"""Token ids of whole texts by the ``tokenizers`` library, word by word through a bounded cache.

Both vocabularies split a text into words before any merge, and every change from a non-space to a space or line feed is
such a split, so the ids of a text are those of its pieces one after another. A piece is encoded by the library once and
then looked up. A piece of letters only, or of letters and one stop or comma, needs no splitting pattern: the library's
BPE model gets its words directly; any other piece goes through the library's whole pipeline.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

CACHE_ENTRIES = 500_000
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces. ``lower``: the vocabulary lower-cases and drops white space.

    When full, the cache becomes the older generation, from which pieces in use come back.
    """

    _letters = _byte_letters()

    def __init__(self, tokenizer: Tokenizer, lower: bool) -> None:
        self.encode, self.model, self.lower = tokenizer.encode, tokenizer.model.tokenize, lower
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.older.get(piece) or self._ids(piece)
        return out

    def _ids(self, piece: str) -> bytes:
        body = piece[1:] if piece[0] == " " else piece
        stop = body[-1:] in (".", ",")
        letters = body[:-1] if stop else body
        if letters.isalpha() and (letters.isascii() or max(letters) <= "ÿ"):
            words = [letters.lower()] if self.lower else [piece[:-1] if stop else piece]
            words += [body[-1]] * stop
            ids = [t.id for word in words for t in self.model(word.encode().decode("latin-1").translate(self._letters))]
        else:
            ids = self.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text. A text with white space other than blanks and line feeds is
    encoded in one go.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self._tokenizer = tokenizer
        self._pieces = _Pieces(tokenizer, lower=tokenizer.normalizer is not None)

    def encode(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self._pieces) > CACHE_ENTRIES:
            self._pieces.age()
        found = text.split() if self._pieces.lower else _PIECE.findall(text)
        return b"".join(map(self._pieces.__getitem__, found))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """The encoder of a file; a Python worker keeps it, and its cache, from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode


def vocabulary(name: str) -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)
