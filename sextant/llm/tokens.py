"""Byte-level BPE ids for whole texts, quick on natural text.

The vocabulary and merges come from a tokenizers file. A single blank before a
non-blank character always starts a new pre-token, so a text is the concatenation of
its blank-led chunks, and chunks repeat: they are kept in a bounded dictionary.
"""

from __future__ import annotations

import json
import re
from array import array

#: Entries kept in a worker's dictionary of chunks; what comes later is encoded each time.
CACHE_ENTRIES = 400_000
#: The split pattern of the byte-level pre-tokenizer (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, ChunkEncoder] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", ())}
        of = byte_alphabet()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._ids = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cache: dict[str, bytes] = {}
        added = spec.get("added_tokens", ())
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self._added = {x["content"]: array("I", [x["id"]]).tobytes() for x in added}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

    def _packed(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        found = list(map(self._cache.get, rest))
        if None in found:
            cache = self._cache
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = rest[i]
                    if not chunk or chunk[0].isspace():  # a run of white space: no boundary before its blanks
                        return self._packed(text)
                    found[i] = ids = self._packed(" " + chunk)
                    if len(cache) < CACHE_ENTRIES and len(chunk) <= 40:
                        cache[chunk] = ids
        return (self._packed(first) if first else b"") + b"".join(found)


    def encode_text(self, text: str) -> bytes:
        """As encode, but an added token that stands in the text is its single id, as the library has it by default."""
        if self._split is None or not any(x in text for x in self._added):
            return self.encode(text)
        return b"".join(self._added.get(x) or self.encode(x) for x in self._split.split(text) if x)


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizers file."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]
