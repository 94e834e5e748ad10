"""Token ids of a public byte-level BPE vocabulary inside tasks.

Byte-level BPE never merges across pre-tokens, so ids are kept by pre-token: a text is split with
the vocabulary's public pattern and each new pre-token is encoded once by the library's BPE model.
Texts that hold one of the vocabulary's special strings go to the library whole."""

from __future__ import annotations

import hashlib

import numpy as np
import regex

from .common import ship

ship(__name__)


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PretokenIds(dict):
    """Little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        import tokenizers

        super().__init__()
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = regex.compile(pattern).findall
        self.most, self.letters = most, byte_letters()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.array([t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text)))
