"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import json
import re

import numpy as np

#: White space as the tokenizer's pattern has it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
#: The tokenizer's pattern cuts before each run of non-space with its one leading space, so no token spans two of these; a chunk that ends in white space is all white space and one piece.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPACE = re.compile(f"[{_WS}]")
_LONGEST = 4096
_LONG = re.compile(f"[{_WS}]{{{_LONGEST}}}")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """Of byte-level vocabularies: a printable character for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class ByteBpe:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes. The merges run in tiktoken, which is faster; the ids are those of tokenizers.

    vocabulary: a tokenizers JSON file of byte-level BPE whose ids are in the order of merging. Strings of its added tokens cut the
    text and get their ids; those of special tokens don't if `special_as_text`."""

    def __init__(self, vocabulary: str, special_as_text: bool = False):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at what is around them aren't supported")
        ids = {t["id"] for t in added}
        byte = _alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in ids}
        own = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._piece = own.encode_ordinary, own._encode_single_piece
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added if not (special_as_text and t["special"])}
        self._cut = re.compile("|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True))) if self._added else None

    def encode(self, text: str) -> bytes:
        if self._cut is None or self._cut.search(text) is None:
            return self._ordinary(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [self._ordinary(text[at : m.start()]), self._added[m[0]]]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> bytes:
        if len(text) < _LONGEST or _LONG.search(text) is None:
            return np.array(self._encode(text), "<u4").tobytes()
        # the pattern's engine keeps a state for each character of white space, of which it has room for a limited number
        return b"".join(np.array(self._piece(c) if _SPACE.match(c[-1]) else self._encode(c), "<u4").tobytes() for c in _CHUNK.findall(text))


_loaded: dict[tuple, ByteBpe] = {}


def byte_bpe(vocabulary: str, special_as_text: bool = False) -> ByteBpe:
    """One for each worker process and file."""
    if (key := (vocabulary, special_as_text)) not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]
