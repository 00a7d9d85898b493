"""Encoding by way of distinct strings: a text's ids are those of its white-space chunks, a chunk's those of its pre-tokens.

This holds for a tokenizer that drops white space and splits on it before anything else, as `word_bpe_49k.json` does
(checked against whole-text encoding in the tests). Every distinct string is given to the library once, and kept in a
memory of bounded size.
"""

from __future__ import annotations

import re

import numpy as np

#: Lower-cased letters and other characters for which the split below is the tokenizer's; other chunks go to the library whole.
LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżžœ"
KNOWN = re.compile(rf"[{LETTERS}0-9!-/:-@\[-`{{-~«»¿¡‘’“”–—…€ \t\n\r\x0b\x0c]*")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9 \t\n\r\x0b\x0c]+")
CACHED = 1_000_000


def simple(text: str, lower: str) -> bool:
    """Whether the split of lower is the tokenizer's split of text."""
    return len(lower) == len(text) and bool(KNOWN.fullmatch(lower)) and "<|" not in text and "İ" not in text


def pretokens(chunk: bytes) -> list[str]:
    """The strings whose ids, one after another, are the chunk's."""
    text = chunk.decode()
    lower = text.lower()
    return SPLIT.findall(lower) if simple(text, lower) else [text]


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_split(tokenizer, path: str) -> None:
    """Refuses a vocabulary whose library splits texts otherwise than this module: its counts would be wrong."""
    probe = "It's we'll 12ab x--y (Z) a  b\tc\nd's e_f"
    normal = tokenizer.normalizer.normalize_str(probe) if tokenizer.normalizer else probe
    theirs = [s for s, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if tokenizer.pre_tokenizer else [normal]
    if theirs != [s for chunk in probe.split() for s in pretokens(chunk.encode())]:
        raise ValueError(f"{path} splits texts otherwise than word_bpe_49k.json does")


class Encoder(dict):
    """pre-token -> its ids as little-endian bytes of `width` bytes each."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        check_split(self.tokenizer, path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")

    def __missing__(self, string: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        found = self[string] = np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, self.kind).tobytes()
        return found

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        lower = text.lower()
        if simple(text, lower):
            return b"".join(map(self.__getitem__, SPLIT.findall(lower)))
        return b"".join(self[x] for chunk in text.encode().split() for x in pretokens(chunk))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine; asked on the executor that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)
