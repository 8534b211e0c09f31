"""Token ids of whole texts, from a file of the tokenizers library.

The tokenizer cuts a text into pre-tokens that never cross a lone space between two other characters, and handles each by
itself. Texts are therefore cut at such spaces, every distinct piece goes through the tokenizer once per worker, and a
text's ids are the joined ids of its pieces. The pieces of many texts are looked up together, each distinct one once, and Arrow
puts their ids in place. The result equals ``encode(text)``; the caches only save work and are bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex

END = (0).to_bytes(4, "little")
PIECES = 800_000
PRE_TOKENS = 300_000
CHUNK_LETTERS = 1 << 22  # letters of texts whose pieces are looked up together

_DOUBLE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_LATIN = re.compile("[\x00-ɏ]*")
#: The pre-token patterns of the two tokenizer files.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: The letter that stands for each byte: itself if printable, else the next free one from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_TABLE = "".join(chr(_LETTERS.get(b, b)) for b in range(256))
_LETTER_SPACE = _TABLE[0x20]
_MARKS = ".,;:!?"


class _Pieces(dict):
    """Ids of pieces by text. A missing one is encoded, and kept while there is room; frequent pieces come early."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.room:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. ``spaced``: the tokenizer keeps spaces (byte level) or drops them.

    A text that holds the string of an added token, which the tokenizer finds before it cuts, goes through the tokenizer whole.
    """

    def __init__(self, path: str, *, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.spaced = spaced
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE)
        self.marks = {c for t in added for c in (t[:1].lower(), t[:1].upper())}  # what an added token begins with
        self.findall = (_BYTE_LEVEL if spaced else _WORD_LEVEL).findall
        self.tokens = _Pieces(self._model, PRE_TOKENS)
        self.pieces = _Pieces(self._piece, PIECES)
        self.firsts = _Pieces(self._direct, PIECES // 8)

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, text: str) -> list[str]:
        """Pieces of a text. With spaces kept, the first comes first and as it is; the others lack their leading space."""
        if not self.spaced:
            return [p for p in text.split(" ") if p]
        if _DOUBLE.search(text):
            first, *rest = _LONE_SPACE.split(text)
            return [first, *(p[1:] for p in rest)]
        return text.split(" ")

    def _model(self, token: str) -> bytes:
        """The ids of one normalised pre-token, through the tokenizer's model, which takes byte-level letters."""
        letters = token.replace(" ", _LETTER_SPACE) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(_TABLE)
        return array("I", [t.id for t in self.model(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece: by its pre-tokens for Latin text, else by the tokenizer as a whole."""
        if not (piece.isascii() or _LATIN.fullmatch(piece)):
            return self._direct(" " + piece if self.spaced else piece)
        text = piece if self.spaced else piece.lower()
        word, mark = (text, "") if text[-1:].isalpha() else (text[:-1], text[-1:])
        if word.isalpha() and (not mark or mark in _MARKS):  # a plain word, as it is or before a punctuation mark, is one pre-token
            token = " " + word if self.spaced else word
            return (self.pieces.get(word) or self.tokens[token]) + self.tokens[mark] if mark else self._model(token)
        return b"".join(map(self.tokens.__getitem__, self.findall(" " + text if self.spaced else text)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order. Null counts as empty."""
        held, letters = [], 0
        for text in texts:
            held.append(text or "")
            letters += len(held[-1])
            if letters >= CHUNK_LETTERS:
                yield from self._encoded(held)
                held, letters = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        heads, pieces, ends = [], [], []  # what comes before a text's pieces, all pieces, and where each text's end
        for text in texts:
            if any(mark in text for mark in self.marks) and self.added.search(text):
                heads.append(self._direct(text))
            elif self.spaced:
                first, *rest = self._split(text)
                heads.append(self.firsts[first] if len(first) < 64 else self._direct(first))
                pieces += rest
            else:
                heads.append(b"")
                pieces += self._split(text)
            ends.append(len(pieces))
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        ids = pa.array(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        offsets = memoryview(offsets).cast("q")
        start = 0
        for head, end in zip(heads, ends):
            stop = offsets[end]
            yield head + data[start:stop].to_pybytes() if stop > start else head
            start = stop


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, *, spaced: bool) -> Encoder:
    """The worker's encoder for a file; its caches live as long as the worker."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaced=spaced)
    return _ENCODERS[key]
