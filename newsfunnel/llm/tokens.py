"""Token ids of whole texts with the public vocabularies, cached by space-separated pieces.

A byte-level BPE never merges across the borders that its splitting pattern draws, and that
pattern always draws one before a single space between two visible characters. So a text is cut
there and every distinct piece is encoded once per worker.
"""

from __future__ import annotations

import base64
import functools
import re
import struct

import public_tokenizers

END_OF_TEXT = "<|endoftext|>"
CACHE_PIECES = 150_000  # entries of one generation (memory only, no effect on ids)
BOTH_PIECES = 300_000  # the same where two vocabularies share a cache
CACHED_CHARS = 64
_CUT = re.compile(r"(?<=\S)(?= \S)")

BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


class ByteBpe:
    """Ids of the 50k byte-level vocabulary as little-endian uint32 bytes."""

    def __init__(self, path: str | None = None):
        import tiktoken

        path = path or public_tokenizers.path(BYTE_BPE)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={END_OF_TEXT: 50256},
        )
        # Two generations: a full one becomes the old one, and what is still used moves back.
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special={END_OF_TEXT})

    def ids(self, piece: str) -> bytes:
        """Ids of one piece, not cached."""
        ids = self.encode(piece) if END_OF_TEXT in piece else self._encoding.encode_ordinary(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        out = self._old.get(piece)
        if out is None:
            out = self.ids(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self._cache) >= CACHE_PIECES:
                self._old, self._cache = self._cache, {}
            self._cache[piece] = out
        return out

    def packed(self, text: str) -> bytes:
        """All ids of `text`, four bytes each."""
        if not text:
            return b""
        make = self._piece
        return b"".join([self._cache.get(p) or make(p) for p in _CUT.split(text)])


class PieceBpe:
    """Pieces of a vocabulary with byte fallback. Its pieces never run across the mark that a single
    space becomes, and a text begins with such a mark: so texts are cut there, the space is left out,
    and every distinct word is encoded once per worker."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(
            model_file=path or public_tokenizers.path(PIECE_BPE))
        self._bytes = bytes(self._model.is_byte(i) for i in range(self._model.get_piece_size()))
        # Two generations, as above; both numbers of a word in one.
        self._cache: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces << 32 | bytes of one word, not cached."""
        ids, fell = self._model.encode(word), self._bytes
        return len(ids) << 32 | sum([fell[i] for i in ids])

    def _word(self, word: str) -> int:
        out = self._old.get(word)
        if out is None:
            out = self.count(word)
        if len(word) <= CACHED_CHARS:
            if len(self._cache) >= CACHE_PIECES:
                self._old, self._cache = self._cache, {}
            self._cache[word] = out
        return out

    def counts(self, text: str) -> tuple[int, int]:
        """(pieces, how many of them are bytes that characters fall back to)."""
        if not text:
            return 0, 0
        make, get = self._word, self._cache.get
        pieces = _CUT.split(text)
        total = make(pieces[0])
        for p in pieces[1:]:
            p = p[1:]
            n = get(p)
            if n is None:
                n = make(p)
                get = self._cache.get
            total += n
        return total >> 32, total & 0xFFFFFFFF


class BothBpe:
    """The ids of one vocabulary and the counts of the other in one pass: a text is cut once and a piece
    is looked up once."""

    def __init__(self, tokens: ByteBpe, pieces: PieceBpe):
        self._ids, self._counts = tokens.ids, pieces.count
        # Two generations, as above.
        self._cache: dict[str, tuple[bytes, int]] = {}
        self._old: dict[str, tuple[bytes, int]] = {}

    def _piece(self, piece: str) -> tuple[bytes, int]:
        out = self._old.get(piece) or (self._ids(piece), self._counts(piece[1:]))
        if len(piece) <= CACHED_CHARS:
            if len(self._cache) >= BOTH_PIECES:
                self._old, self._cache = self._cache, {}
            self._cache[piece] = out
        return out

    def measure(self, text: str) -> tuple[bytes, int, int]:
        """(ids, pieces, bytes that characters fall back to), as `packed` and `counts` give them."""
        if not text:
            return b"", 0, 0
        make = self._piece
        first, *rest = _CUT.split(text)  # the first piece has no space that stands for a mark
        found = [self._cache.get(p) or make(p) for p in rest]
        total = self._counts(first) + sum([n for _, n in found])
        return self._ids(first) + b"".join([ids for ids, _ in found]), total >> 32, total & 0xFFFFFFFF


@functools.cache
def byte_bpe(path: str | None = None) -> ByteBpe:
    """One per worker, so that its cache serves all tasks of the worker."""
    return ByteBpe(path)


@functools.cache
def piece_bpe(path: str | None = None) -> PieceBpe:
    return PieceBpe(path)


@functools.cache
def both_bpe(byte_path: str | None = None, piece_path: str | None = None) -> BothBpe:
    return BothBpe(byte_bpe(byte_path), piece_bpe(piece_path))
