"""Byte-level BPE ids over whole texts, with a bounded cache of word chunks in each worker."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
#: Chunks kept in a worker before its cache starts anew, and the longest chunk kept.
CACHED_CHUNKS, CACHED_CHARS = 500_000, 48
#: A space that white space or the end follows: there the pattern's white-space rule looks further than a chunk.
UNSAFE = re.compile(r" (?:\s|\Z)")


class _Chunks(dict):
    """Chunk (without its leading space) to its value; missing ones are made, and kept within bounds."""

    def __init__(self, lead: str, make):
        super().__init__()
        self.lead, self.make = lead, make

    def __missing__(self, chunk: str):
        value = self.make(self.lead + chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


class ByteBpe:
    """Ids equal to ``Tokenizer.from_file(<vocabulary>.json).encode(text, add_special_tokens=False)``.

    A text is cut before each single space: the pre-tokenizer's pattern always starts a new word
    there, so chunks encode alone, and repeated ones come from the cache. Chunks are merged by the
    rank file of the same vocabulary; texts that hold a special token's string or white space that
    the cut could change go whole through the tokenizer file.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.width = np.zeros(max(ranks.values()) + 2, dtype=np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        for i, t in self.slow.get_added_tokens_decoder().items():
            self.width[i] = len(t.content.encode())
        self.first, self.rest = _Chunks("", self._merge), _Chunks(" ", self._merge)

    def _merge(self, chunk: str) -> bytes:
        return np.array(self.fast.encode_ordinary(chunk), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str = VOCABULARY) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(vocabulary)
