"""Byte-level vocabularies in the tokenizers library's JSON form, read for our own use."""

from __future__ import annotations

import json
from functools import lru_cache

# Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """The 50k byte-level vocabulary of this machine's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of every byte in such files: itself where it prints, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, ids by bytes, merge ranks by pair of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = printable_bytes()
        raw = lambda s: bytes(back[c] for c in s)
        model = data["model"]
        self.pattern = PATTERN
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        own = {s: i for s, i in model["vocab"].items() if s not in self.special}
        self.ranks = {raw(s): i for s, i in own.items()}
        self.tokens: list[bytes] = [b""] * (max([*own.values(), *self.special.values()]) + 1)
        for b, i in self.ranks.items():
            self.tokens[i] = b
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.byte_ids = [self.ranks.get(bytes((b,)), -1) for b in range(256)]
        self.merges: dict[int, int] = {}  # left << 17 | right -> rank << 17 | joined
        if len(self.tokens) > 1 << 17:
            raise ValueError("more than 131072 ids")
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.merges[own[a] << 17 | own[b]] = rank << 17 | own[a + b]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
