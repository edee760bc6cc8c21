"""Token ids of whole texts by the tokenizers library, with a cache of the pieces between which no token can reach.

White space bounds the pre-tokens of both vocabularies, so a text's ids are those of its pieces in order. A piece of plain
letters, digits and punctuation is split as the vocabulary's own pattern splits it, and the library's model encodes each part;
any other piece goes through the whole tokenizer. Pieces are cached, and so are the parts of pieces that have several. Texts
whose white space could join across a cut are encoded whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from tokenizers import Tokenizer

from gradus.llm.common import held

#: Cached pieces of a generation in a worker, and cached parts. A full generation becomes the older one, and the one before it goes.
CACHE, PARTS = 450_000, 50_000

_ODD_SPACE = rb"\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: A byte-level vocabulary's text is cut before single spaces; these texts are not.
_UNCUT = re.compile(rb"  |[\t-\r] [\t-\r]|[" + _ODD_SPACE)
#: A text without any of these is cut without a further look.
_SIGNS = (b"  ", b"\t ", b"\n ", b"\x0b ", b"\x0c ", b"\r ", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")
_PLAIN_ASCII, _LOWER_ASCII = bytes([10, *range(32, 127)]), bytes([10, *range(32, 65), *range(91, 127)])
_PLAIN = re.compile(rb"(?:[\n -~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_SPACED = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?" + _LETTER + rb"+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
_LOWER = re.compile(rb"(?:[\n -@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])*")
_UNSPACED = re.compile(rb"'(?:[stmd]|re|ve|ll)|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^\sa-z0-9\x80-\xff]+")


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class _Cache(dict):
    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        self[key] = out = self.make(key) if out is None else out
        return out


class Encoder:
    """Ids of UTF-8 texts as little-endian arrays of ``dtype``. ``literal``: special tokens' strings are ordinary text."""

    def __init__(self, path: str, literal: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.special = re.compile(rb"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or rb"(?!)")
        self.model, self.letters, self.code = self.tokenizer.model, _byte_letters(), "H" if self.dtype.itemsize == 2 else "I"
        self.parts, self.pieces = _Cache(self._part, PARTS), _Cache(self._piece, CACHE)
        self.spaced = _Cache(lambda piece: self._piece(b" " + piece), CACHE)  # by what follows the space

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: bytes) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: bytes) -> bytes:
        ascii_, plain, pattern = (_LOWER_ASCII, _LOWER, _UNSPACED) if self.lowers else (_PLAIN_ASCII, _PLAIN, _SPACED)
        if self.special.search(piece) or piece.translate(None, ascii_) and not plain.fullmatch(piece):
            return self._whole(piece)
        if piece.removeprefix(b" ").isalpha():
            return self._part(piece)
        return b"".join([self._cached(part) for part in pattern.findall(piece)])

    def _cached(self, part: bytes) -> bytes:
        """A part's ids; those of a word are kept with the words that stand alone."""
        if not part.removeprefix(b" ").isalpha():
            return self.parts[part]
        return self.pieces[part] if self.lowers else self.spaced[part[1:]] if part[:1] == b" " else self.parts[part]

    def encode(self, text: bytes | None) -> bytes:
        """The ids' bytes; null and empty texts have none."""
        if not text:
            return b""
        if self.lowers:
            lowered = text if b"<|" in text else text.lower()
            return b"".join(map(self.pieces.__getitem__, lowered.split()))
        if any(map(text.__contains__, _SIGNS)) and _UNCUT.search(text):
            return self._whole(text)
        first, *rest = text.split(b" ")
        return self._piece(first) + b"".join(map(self.spaced.__getitem__, rest))


def encoder(path: str, literal: bool = False) -> Encoder:
    """One encoder in each worker process, whose cache lasts over its tasks."""
    return held(("encoder", path, literal), lambda: Encoder(path, literal))
