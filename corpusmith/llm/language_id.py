"""Language identification by unigram pieces, marginalised over segmentations.

The vocabulary is fixed and public (byte pieces of a tokenizer). Each language
has a probability for each piece, fitted by expectation maximisation on a
bounded sample of labelled documents. A text's likelihood is the sum, over all
ways to segment it into pieces, of the product of their probabilities. A unit is
a word (run of other than white space) with one space before it; no piece
reaches over a unit's end, so the sum factors into one forward pass a unit, and
each distinct word of a slice of texts is passed once.

Defined results: a null text, or one without a word, has a null language and a
likelihood of 0; a tie goes to the language first in order; rows without a label,
or with a null text or doc_id, don't train, but are scored; without any labelled
row every language is null; repeated rows are scored each, but of rows with one
doc_id and label one trains; very long texts and words are scored, and train,
whole; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import checked_broadcast, drop_written, written
from corpusmith.functions.ship import map_arrow, ship

from . import textops as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Labelled documents of a language that train it at most: those whose md5(doc_id) is least.
TRAIN_DOCS = 400
ROUNDS, SMOOTHING = 4, 0.02
#: Bytes of a word up to which it is passed with others, unscaled; a longer one is passed alone, in logarithms, in training as in scoring.
SHORT = 48
_BASE = np.uint64(0x5851F42D4C957F2D)


class Pieces(NamedTuple):
    """Hashes by length (sorted) and the piece of each; total: number of ids."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    texts: dict[bytes, int]
    total: int


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) % 2**64
    return h


@functools.lru_cache(4)
def pieces(path: str = VOCABULARY) -> Pieces:
    """Those of the vocabulary that can lie in a unit: white space only as one leading space. Every single byte is one."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return piece_table(ranks)


def piece_table(ranks: dict[bytes, int]) -> Pieces:
    fit = {p: r for p, r in ranks.items() if not set(p[1:]) & set(b"\t\n\f\r ") and p[:1] not in b"\t\n\f\r"}
    by_length = {}
    for n in sorted({len(p) for p in fit}):
        h = np.array([_hash(p) for p in fit if len(p) == n], np.uint64)
        r = np.array([r for p, r in fit.items() if len(p) == n], np.int64)
        order = np.argsort(h)
        marks = np.zeros(1 << 18, bool)
        marks[(T.mix(h) & np.uint64(marks.size - 1)).astype(np.int64)] = True
        by_length[n] = (h[order], r[order], marks)
    return Pieces(by_length, fit, max(ranks.values()) + 1)


class Lattice(NamedTuple):
    """All pieces of some units laid end to end. steps: for each end offset, the edges that end there."""

    first: np.ndarray
    last: np.ndarray
    size: int
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def lattice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Pieces) -> Lattice:
    """For units that are a space and data[start:end]. Node first[u] + j is the place after j bytes of unit u."""
    n = ends - starts + 1
    first = np.r_[0, np.cumsum(n + 1)]
    size = int(first[-1])
    text = np.full(size, 32, np.int64)
    inner = np.arange(size) - np.repeat(first[:-1], n + 1)
    body = (inner >= 1) & (inner < np.repeat(n, n + 1))
    text[body] = data[(np.repeat(starts, n + 1) + inner - 1)[body]]
    left = np.repeat(n, n + 1) - inner
    h = np.zeros(size, np.uint64)
    at = np.flatnonzero(left > 0)
    froms, tos, ids = [], [], []
    for length in range(1, max(vocabulary.by_length) + 1):
        at = at[left[at] >= length]
        if not len(at):
            break
        h[at] = h[at] * _BASE + (text[at + length - 1] + 1).astype(np.uint64)
        if length not in vocabulary.by_length:
            continue
        hashes, ranks, marks = vocabulary.by_length[length]
        hit = at[marks[(T.mix(h[at]) & np.uint64(marks.size - 1)).astype(np.int64)]]
        to = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
        good = hashes[to] == h[hit]
        froms.append(hit[good])
        tos.append(hit[good] + length)
        ids.append(ranks[to[good]])
    a, b, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, tos, ids))
    offset = inner[b]
    order = np.lexsort((b, offset))
    a, b, p, offset = a[order], b[order], p[order], offset[order]
    cuts = np.r_[0, np.flatnonzero(offset[1:] != offset[:-1]) + 1, len(offset)]
    return Lattice(first[:-1], first[:-1] + n, size, [(a[x:y], b[x:y], p[x:y]) for x, y in zip(cuts[:-1], cuts[1:]) if y > x])


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each node. prob: (pieces, languages)."""
    alpha = np.zeros((lat.size, prob.shape[1]))
    alpha[lat.first] = 1
    for a, b, p in lat.edges:
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        alpha[b[at]] = np.add.reduceat(alpha[a] * prob[p], at, axis=0)
    return alpha


def expected(lat: Lattice, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece, for one language (prob a vector) and weighted units."""
    alpha = forward(lat, prob[:, None])[:, 0]
    beta = np.zeros(lat.size)
    total = alpha[lat.last]
    beta[lat.last] = np.divide(weight, total, out=np.zeros(len(total)), where=total > 0)
    out = np.zeros(len(prob))
    for a, b, p in reversed(lat.edges):
        through = prob[p] * beta[b]
        np.add.at(beta, a, through)
        out += np.bincount(p, alpha[a] * through, len(out))
    return out


def long_unit(unit: bytes, vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log likelihoods of one unit of any length: the forward pass over a ring of the last places, in logarithms."""
    longest = max(vocabulary.by_length)
    ring = np.full((longest + 1, prob.shape[1]), -np.inf)
    ring[0] = 0
    for j in range(1, len(unit) + 1):
        total = np.full(prob.shape[1], -np.inf)
        for n in range(1, min(j, longest) + 1):
            rank = vocabulary.texts.get(unit[j - n : j])
            if rank is not None:
                total = np.logaddexp(total, ring[(j - n) % (longest + 1)] + np.log(prob[rank]))
        ring[j % (longest + 1)] = total
    return ring[len(unit) % (longest + 1)].copy()


def long_expected(unit: bytes, vocabulary: Pieces, prefixes: set[bytes], prob: np.ndarray, weight: float, out: np.ndarray) -> None:
    """Adds the expected counts of one unit of any length to out: forward and backward over its places, in logarithms."""
    n = len(unit)

    def edges(i: int) -> Iterator[tuple[int, int]]:
        for j in range(i + 1, n + 1):
            piece = unit[i:j]
            if piece not in prefixes:
                return
            rank = vocabulary.texts.get(piece)
            if rank is not None:
                yield j, rank

    def summed(a: float, b: float) -> float:
        a, b = max(a, b), min(a, b)
        return a + math.log1p(math.exp(b - a)) if b > -math.inf else a

    log_prob: dict[int, float] = {}
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for j, rank in edges(i):
            if rank not in log_prob:
                log_prob[rank] = math.log(prob[rank])
            alpha[j] = summed(alpha[j], alpha[i] + log_prob[rank])
    for i in range(n - 1, -1, -1):
        for j, rank in edges(i):
            through = log_prob[rank] + beta[j]
            beta[i] = summed(beta[i], through)
            out[rank] += weight * math.exp(alpha[i] + through - alpha[n])


def distinct(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """A word of each kind, and the kind of each word."""
    _, one, kind = np.unique(T.word_hashes(w), return_index=True, return_inverse=True)
    return one, kind


def word_scores(w: T.Words, one: np.ndarray, vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of each of the words one, by language."""
    out = np.zeros((len(one), prob.shape[1]))
    size = w.ends[one] - w.starts[one]
    brief = np.flatnonzero(size < SHORT)
    for lo in range(0, len(brief), 40_000):
        part = brief[lo : lo + 40_000]
        lat = lattice(w.data, w.starts[one[part]], w.ends[one[part]], vocabulary)
        out[part] = np.log(forward(lat, prob)[lat.last])
    for k in np.flatnonzero(size >= SHORT):
        out[k] = long_unit(b" " + w.data[w.starts[one[k]] : w.ends[one[k]]].tobytes(), vocabulary, prob)
    return out


class Model(NamedTuple):
    languages: list[str]
    prob: np.ndarray


def _fit(path: str, rounds: int, smoothing: float):
    def go(rows: pd.DataFrame) -> pd.DataFrame:
        v = pieces(path)
        texts = pa.array(rows["text"].tolist(), pa.string())
        weight: dict[bytes, int] = {}
        long: dict[bytes, int] = {}
        for lo, hi in T.slices(texts):
            w = T.words(texts[lo:hi], T.SPACED)
            one, kind = distinct(w)
            for k, n in zip(one, np.bincount(kind, minlength=len(one))):
                word = w.data[w.starts[k] : w.ends[k]].tobytes()
                to = weight if len(word) < SHORT else long
                to[word] = to.get(word, 0) + int(n)
        usable = np.array(sorted(v.texts.values()))
        prob = np.zeros(v.total)
        prob[usable] = 1 / len(usable)
        prefixes = {x[:k] for x in v.texts for k in range(1, len(x) + 1)} if long else set()
        if weight or long:
            data = np.frombuffer(b"".join(weight), np.uint8)
            ends = np.cumsum(np.array([len(x) for x in weight], np.int64))
            starts = ends - np.array([len(x) for x in weight], ends.dtype)
            counts = np.array([*weight.values()], float)
            parts = [(lattice(data, starts[i : i + 40_000], ends[i : i + 40_000], v), counts[i : i + 40_000]) for i in range(0, len(ends), 40_000)]
            for _ in range(rounds):
                total = np.zeros(v.total)
                for lat, c in parts:
                    total += expected(lat, prob, c)
                for word, c in long.items():
                    long_expected(b" " + word, v, prefixes, prob, c, total)
                prob[usable] = (total[usable] + smoothing) / (total[usable].sum() + smoothing * len(usable))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "prob": [prob]})

    return go


def train(docs: DataFrame, vocabulary: str = VOCABULARY, docs_each: int = TRAIN_DOCS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """A model of the languages that label docs, from docs_each documents of each at most."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text")).where("lang is not null and text is not null and doc_id is not null")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # The ids are ranked first, without the texts. They are docs_each a label at most, but labels may be many.
    ids = rows.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(_by("lang", order))).where(F.col("k") <= docs_each).select("doc_id", "lang")
    ids = written(ids, "training_ids")
    sample = rows.join(checked_broadcast(ids, 48), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    fitted = sample.groupBy("lang").applyInPandas(_fit(vocabulary, rounds, smoothing), "lang string, prob array<double>").orderBy("lang").collect()
    drop_written(ids)
    return Model([r.lang for r in fitted], np.array([r.prob for r in fitted]).T if fitted else np.zeros((0, 0)))


def _by(key: str, order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order, "doc_id")


class _Score:
    def __init__(self, model: Model, path: str):
        self.model, self.path = model, path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (names, prob) = pieces(self.path), self.model
        for b in batches:
            for lo, hi in T.slices(b.column("text"), 2 << 20):
                part = b.slice(lo, hi - lo)
                w = T.words(part.column("text"), T.SPACED)
                n = w.lengths()
                score = np.zeros((len(n), max(1, len(names))))
                if len(w.starts) and names:
                    one, kind = distinct(w)
                    each = word_scores(w, one, v, prob)[kind]
                    used = np.flatnonzero(n)
                    score[used] = np.add.reduceat(each, w.offsets[:-1][used], axis=0)
                best = score.argmax(axis=1)
                top = score[np.arange(len(n)), best]
                rest = score.copy()
                rest[np.arange(len(n)), best] = -np.inf
                margin = np.where(np.isfinite(rest.max(axis=1)), top - rest.max(axis=1), 0.0) if score.shape[1] > 1 else np.zeros(len(n))
                none = (n == 0) | (not names)
                language = pa.array([None if x else names[k] for x, k in zip(none, best)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), language, pa.array(top), pa.array(np.where(none, 0.0, margin)), pa.array(n)], ["doc_id", "language", "log_likelihood", "margin", "n_words"])


def identified(docs: DataFrame, model: Model, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, language, its log likelihood, how far the next language is behind, and the number of words. A narrow pass."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_arrow(rows, _Score(model, vocabulary), "doc_id long, language string, log_likelihood double, margin double, n_words long")
