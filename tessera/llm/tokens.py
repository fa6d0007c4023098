"""Exact byte-level BPE encoding with the tokenizers library and bounded caches of pieces.

Every pre-token of a byte-level BPE starts at a blank or lies inside a run without
blanks, so a run of blanks with the following run of other characters is encoded
alike alone and inside its text.  That makes ids of a text the concatenation of ids
of its pieces, most of which recur.  A new piece is parted by the vocabulary's own
pre-token pattern, and the library's BPE model encodes each part.  Where no blank or line feed follows another one,
the text is simply cut before each of them, which needs no pattern.  Texts with other white
space than space, tab and line feed, texts that hold the start of a special token, and
vocabularies of another kind are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

from .common import worker_cache

END_ID = 2
_PIECE = re.compile(r"[ \n\t]*\S+|[ \n\t]+")
_ODD_SPACE = re.compile(r"[^\S \n\t]")
# fixed values: what a text that is cut before each blank and line feed must not hold
_NOT_CUT = ("  ", "\n\n", " \n", "\n ", "\t", "\0")
SEEN = 1 << 22
# fixed value: the pre-token pattern of byte-level BPE vocabularies
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class OddSpace(ValueError):
    """A piece with white space that pieces do not know."""


class _Cache(dict):
    """Ids of strings encoded alone, as little-endian bytes.

    Pieces and the pre-tokens inside them share it.  Its second half takes only strings that are met again, so that
    those which occur once do not fill it.  It is emptied after many misses, so that it follows a change of language.
    """

    def __init__(self, model, vocabulary: int, most: int):
        self.model, self.most, self.misses = model, most, 0
        self.ids = [k.to_bytes(4, "little") for k in range(vocabulary)]
        self.letters = byte_letters()
        self.seen = bytearray(SEEN)  # by hash

    def _token(self, part: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            return b""
        if piece[0] == " " and piece[1:].isalpha():
            out = self._token(piece)
        elif piece[0] == " " and piece[-1] in ".,!?:;" and piece[1:-1].isalpha():
            out = self[piece[:-1]] + self[piece[-1]]
        else:
            if _ODD_SPACE.search(piece):
                raise OddSpace
            parts = PRE_TOKEN.findall(piece)
            out = self._token(piece) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        self.misses += 1
        if self.misses > 20 * self.most:
            self.clear()
            self.seen = bytearray(SEEN)
            self.misses = 0
        if len(self) < self.most and len(piece) < 64:
            at = hash(piece) % SEEN
            if self.seen[at] or len(self) < self.most // 2:
                self[piece] = out
            self.seen[at] = 1
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, cache_entries: int = 500_000, plain: bool = False):
        """With ``plain``, strings of special tokens in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.plain = plain
        # the parts are asked one by one: the whole file as one object would take many times its size
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        model = self.tokenizer.model
        self.by_piece = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and type(model).__name__ == "BPE" and not model.dropout
        self.pieces = _Cache(self.tokenizer.model, self.tokenizer.get_vocab_size(), cache_entries)

    def encode(self, text: str) -> bytes:
        if self.by_piece and (self.plain or "<|" not in text):
            if any(x in text for x in _NOT_CUT):
                pieces = _PIECE.findall(text)
                known = sum(map(len, pieces)) == len(text)  # else it has other white space, which pieces leave out
            else:
                pieces, known = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"), True
            if known:
                try:
                    return b"".join(map(self.pieces.__getitem__, pieces))
                except OddSpace:
                    pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def local_path(name_or_path: str) -> str:
    """A bare name is looked up among the installed vocabularies."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def encoder(name_or_path: str, cache_entries: int = 500_000) -> Encoder:
    """One encoder per Python worker."""
    return worker_cache(("encoder", name_or_path, cache_entries), lambda: Encoder(local_path(name_or_path), cache_entries))
