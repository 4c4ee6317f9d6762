"""Array-at-a-time text primitives over Arrow string columns: words, hashes, n-gram hashes, sliding minima.

Nothing here makes a Python object for a word. A batch of texts is one byte
array plus offsets, and every step is a few numpy passes over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK_BYTES = 4 << 20

#: Words are runs of bytes other than tab, newline, form feed, carriage return and space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 12, 13, 32]] = False
#: Words are runs of ASCII letters and digits and of any other than ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: The same words as regular expressions of what lies between them.
SPACED_GAP, ALNUM_GAP = r"[\t\n\f\r ]+", r"[\x00-/:-@\[-`{-\x7f]+"

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)
_BASE = 0x5851F42D4C957F2D | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S33)


class Words(NamedTuple):
    """Words of some texts, in order. offsets: of each text's first word, and the end; starts, ends: bytes in data."""

    data: np.ndarray
    text_at: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offset of each text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about chunk_bytes each; a longer text is a range of its own."""
    _, at = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk_bytes, "right")) - 1)
        yield lo, hi
        lo = hi


def words(texts: pa.Array, inside: np.ndarray) -> Words:
    """Maximal runs of bytes that inside marks. No run crosses from one text to the next."""
    data, at = raw(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, at, np.zeros(len(at), np.int64), none, none)
    on = inside[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    cuts = at[:-1][np.diff(at) > 0]
    first[cuts] = on[cuts]
    last = on.copy()
    last[:-1] &= ~on[1:]
    last[cuts[1:] - 1] = on[cuts[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, np.searchsorted(starts, at), starts, ends)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, read eight at a time."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(w.data) + 1,), "<u8", padded, strides=(1,))
    size = w.ends - w.starts
    h = mix((eights[w.starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _M3)
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        left = size[more] - done
        h[more] = mix(h[more] * _M3 + (eights[w.starts[more] + done] & _MASKS[np.minimum(left, 8)]))
        more, done = more[left > 8], done + 8
    return h


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """out[i]: a hash of h[i : i + n]. Runs cross texts; the caller drops those that do."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, out, power, base = 0, None, h, _BASE
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out = power
                else:
                    m = min(len(out), len(power) - done)
                    out = out[:m] + power[done : done + m] * np.uint64(pow(_BASE, done, 1 << 64))
                done += size
            if done == n:
                return mix(out[: len(h) - n + 1])
            power = power[: len(power) - size] + power[size:] * np.uint64(base)
            base, size = base * base % (1 << 64), size * 2


def whole(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 runs of n words lie in one text."""
    at = np.arange(max(0, total - n + 1))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    return at + n <= ends


def sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """out[i]: pick over x[i : i + n], by doubling."""
    if len(x) < n:
        return x[:0]
    out, size = x, 1
    while size * 2 <= n:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    return pick(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])
