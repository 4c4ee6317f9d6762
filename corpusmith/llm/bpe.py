"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A long text is halved until its parts are leaves, the leaves are encoded alone,
and neighbours are joined up the tree. A join encodes anew only a window around
the seam. It grows to both sides until each end of it is a place that no
pre-token can cross: a letter, digit or printable sign followed by a space or
line feed (in the vocabulary's pattern white space comes only first in, or is
all of, a pre-token, and no look-ahead goes past that white space). Tokens
outside of such a window are the same in any surroundings, so the join equals
the encoding of the joined text. If no such place exists on one side, the
window takes that whole side.

Leaves and windows, which are what is encoded, go through a public byte-pair
library with the vocabulary's merges; a text of up to LEAF characters is one leaf.

Decoding joins the bytes of leaf-sized runs of tokens up the tree.

Defined results: a null text has null tokens and an empty text an empty list;
repeated rows are encoded each; other columns are not read; empty tables give
empty tables. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from corpusmith.functions.ship import map_arrow

from . import textops as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; tokens of a leaf when decoding.
LEAF = 8192
WINDOW = 64

_STABLE = re.compile(r"[!-~\w](?=[ \n])")


class Codec:
    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for piece, rank in ranks.items():
            self._bytes[rank] = len(piece)
        self._leaf = self._encoding.encode_ordinary

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self._leaf(text)
        return self._range(text, 0, len(text), leaf)

    def _range(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= max(leaf, 1):
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._range(text, lo, mid, leaf), self._range(text, mid, hi, leaf))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        begin = end = None
        size = WINDOW
        while begin is None:
            at = max(lo, mid - size)
            places = [m.end() for m in _STABLE.finditer(text, at, mid) if m.end() < mid]
            begin = places[-1] if places else lo if at == lo else None
            size *= 2
        size = WINDOW
        while end is None:
            at = min(hi, mid + size)
            # The look-ahead sees the character at the end of the range only if the range holds it.
            place = next((m.end() for m in _STABLE.finditer(text, mid, at) if m.end() < at), None)
            end = place if place is not None else hi if at == hi else None
            size *= 2
        a = len(left) - self._count(reversed(left), len(text[begin:mid].encode()))
        b = self._count(right, len(text[mid:end].encode()))
        return left[:a] + self._leaf(text[begin:end]) + right[b:]

    def _count(self, tokens, size: int) -> int:
        """How many of the tokens make up so many bytes."""
        n = 0
        for t in tokens:
            if size <= 0:
                break
            size -= int(self._bytes[t])
            n += 1
        assert size == 0, "a stable place must be a token's border"
        return n

    def decode(self, tokens: list[int], leaf: int = LEAF) -> bytes:
        if len(tokens) <= leaf:
            return self._encoding.decode_bytes(tokens)
        mid = len(tokens) // 2
        return self.decode(tokens[:mid], leaf) + self.decode(tokens[mid:], leaf)


@functools.lru_cache(4)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


class _Encode:
    def __init__(self, vocabulary: str, leaf: int):
        self.vocabulary, self.leaf = vocabulary, leaf

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(self.vocabulary)
        for b in batches:
            for lo, hi in T.slices(b.column("text"), 1 << 20):
                part = b.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                flat, sizes, exact = [], [], []
                for text in texts:
                    tokens = c.encode(text, self.leaf) if text is not None else []
                    exact.append(None if text is None else c.decode(tokens, self.leaf) == text.encode())
                    sizes.append(len(tokens))
                    flat.append(np.array(tokens, np.int32))
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                missing = pa.array([x is None for x in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes, pa.int64(), mask=np.array([x is None for x in texts])), pa.array(exact, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])


class _Decode:
    def __init__(self, vocabulary: str, leaf: int):
        self.vocabulary, self.leaf = vocabulary, leaf

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(self.vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [None if x is None else c.decode(x, self.leaf).decode("utf-8", "replace") for x in part.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, tokens, n_tokens, and whether decoding them gives the text back exactly. A narrow pass."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_arrow(rows, _Encode(vocabulary, leaf), "doc_id long, tokens array<int>, n_tokens long, exact boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id and text of rows of doc_id and tokens."""
    return map_arrow(tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), tokens["tokens"].alias("tokens")), _Decode(vocabulary, leaf), "doc_id long, text string")
