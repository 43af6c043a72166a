"""Byte-level BPE ids of whole texts, by a unit cache in front of the public vocabulary."""

from __future__ import annotations

import base64
import json
import os

#: Units whose ids one Python worker keeps; the cache starts anew beyond it.
CACHE_UNITS = 400_000

_LOADED: dict[str, object] = {}


class UnitEncoder:
    """ids(text) as little-endian unsigned 32-bit numbers in bytes.

    The vocabulary's pre-tokenizer never joins a non-space with a following space, so a text cut before
    each single space that a non-space follows gives units whose ids do not depend on their neighbours.
    Texts with other runs of blanks, or with one of the vocabulary's added tokens, are encoded in one go: an added
    token's string is one id, as the vocabulary's own library has it, and what is between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = tuple(added)
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        head, *units = text.split(" ")
        if "" in units or any(u[0].isspace() for u in units) or text[0].isspace() or any(x in text for x in self.added):
            return self.whole(text)
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        cache = self.cache
        out = [self.whole(head)] if head else []
        for u in units:
            got = cache.get(u)
            if got is None:
                got = self.whole(" " + u)
                if len(u) < 64:
                    cache[u] = got
            out.append(got)
        return b"".join(out)


def encoder(vocabulary: str = "byte_bpe_50k") -> UnitEncoder:
    """The worker's encoder for a public vocabulary; loaded once a process."""
    if vocabulary not in _LOADED:
        import public_tokenizers

        added: dict[str, int] = {}
        if os.path.exists(described := public_tokenizers.path(f"{vocabulary}.json")):
            with open(described, encoding="utf-8") as text:
                added = {t["content"]: t["id"] for t in json.load(text)["added_tokens"]}
        _LOADED[vocabulary] = UnitEncoder(public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN, added)
    return _LOADED[vocabulary]
