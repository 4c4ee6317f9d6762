"""Suffix-array deduplication by distributed prefix doubling.

Suffixes begin at words (runs of other than white space). A suffix's rank at
depth h orders it by its first h words. Each round makes pairs of the ranks of a
place and of the place h words on (at the end: as many as are missing to the
threshold), which Spark sorts, and gives every pair its rank for twice the depth.
A suffix that is alone with its pair is unique and leaves; those left at the depth
of the threshold (a parameter, 50 words in production) begin a passage that occurs
again.

* The first rank is a hash of 16 words (of the power of two up to half of the
  threshold), so rounds below need no sort. It also seeds the candidates: of every
  50 words the least such hash is taken (35 places to choose from), so any two equal
  passages of 50 words take the same one. A place in no window with a seed that
  occurs twice is unique by depth 50 and never enters a sort.
* Rounds for 50 words: 16 + 16 = 32, 32 + 18 = 50. For 75: 32 + 32, 64 + 11. For 20: 8 + 8, 16 + 4.

Pairs are sorted over ranges of (pair, document, place), which Spark samples, so
the places of one common passage spread over as many tasks as they need. A rank is
the number of the range and the row in it where its group begins. A group may go
on over ranges: each tells its first and last group, two rows a range, and those of
one pair are joined.

Texts are written once, in blocks (see blocks): which documents are identical (they
enter once), which places are seeds, and which words go, comes back to them by
block. No step shuffles texts.

Result: the maximal runs of words covered by repeated passages; ``removed`` runs
leave out the passage's first occurrence (least doc_id, then place).

Defined results: repeats within one document count; overlapping ones too; a
null text is empty and a text under the threshold has no run; very long texts are
taken whole; repeated rows (same doc_id and text) are one document; ties in doc_id
go by the hash of the text; an empty table gives an empty result; other columns
are not read. A threshold under two words raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.shared import checked_broadcast, delete, drop_written, written
from corpusmith.functions.ship import map_arrow

from . import textops as T
from .blocks import Side, release, send, stored
from .entities import KEY, did, doc_id, th

THRESHOLD = 50
#: Bytes of pairs that one task sorts.
SORT_BYTES = 128 << 20

_POSITIONS = "a long, b long, did long, th long, pos int"
_PLACE = ("did", "th", "pos")


def rounds(threshold: int) -> tuple[int, list[int]]:
    """The words of the first rank, and by how many each round deepens it."""
    if threshold < 2:
        raise ValueError("the threshold is two words at least")
    seed = depth = 1 << ((threshold // 2).bit_length() - 1)
    steps = []
    while depth < threshold:
        steps.append(min(depth, threshold - depth))
        depth += steps[-1]
    return seed, steps


class _Seeds:
    """Of documents that are no copies: the places of each window's least hash."""

    def __init__(self, threshold: int, copies: str):
        self.threshold, self.copies = threshold, copies

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, seed = Side(self.copies), rounds(self.threshold)[0]
        for batch in batches:
            for b, (begin, end), _ in side.cut(batch):
                b = b.take(pa.array(np.flatnonzero(begin == end)))
                texts, did, th = b.column("text"), b.column("did").to_numpy(), b.column("th").to_numpy()
                for lo, hi in T.slices(texts):
                    w = T.words(texts[lo:hi], T.SPACED)
                    if not (w.lengths() >= self.threshold).any():
                        continue
                    g = T.ngram_hashes(T.word_hashes(w), seed)
                    # Of each window that lies in one text: its least hash; chosen are the places that equal such a minimum.
                    span = self.threshold - seed + 1
                    if len(g) < span:
                        continue
                    least = T.sliding(g, span, np.minimum)
                    inside = T.whole(w.offsets, self.threshold, len(w.starts))
                    bound = np.where(inside[: len(least)], least, np.uint64(0))
                    none = np.zeros(span - 1, np.uint64)
                    reach = T.sliding(np.concatenate([none, bound, none]), span, np.maximum)[: len(g)]
                    at = np.flatnonzero(reach == g)
                    owner = np.searchsorted(w.offsets, at, "right") - 1
                    keep = at + seed <= w.offsets[owner + 1]
                    at, owner = at[keep], owner[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[at].view(np.int64)), pa.array(np.zeros(len(at), np.int64)), pa.array(did[lo + owner]), pa.array(th[lo + owner]), pa.array((at - w.offsets[owner]).astype(np.int32))],
                        ["a", "b", *_PLACE],
                    )


class _Candidates:
    """The first round's pairs of each place that may begin a repeated passage, and of the places that later rounds reach from there."""

    def __init__(self, threshold: int, seeds: str):
        self.threshold, self.seeds = threshold, seeds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, threshold, (seed, steps) = Side(self.seeds, "pos"), self.threshold, rounds(self.threshold)
        for batch in batches:
            for b, (begin, end), (places,) in side.cut(batch):
                rows = np.flatnonzero(end > begin)
                b, begin, end = b.take(pa.array(rows)), begin[rows], end[rows]
                texts, did, th = b.column("text"), b.column("did").to_numpy(), b.column("th").to_numpy()
                for lo, hi in T.slices(texts):
                    w = T.words(texts[lo:hi], T.SPACED)
                    g = T.ngram_hashes(T.word_hashes(w), seed)
                    n, of = len(w.starts), np.repeat(w.offsets[:-1], (end - begin)[lo:hi])
                    s = np.concatenate([places[x:y] for x, y in zip(begin[lo:hi], end[lo:hi])]).astype(np.int64) + of
                    near = np.zeros(n + 1, np.int32)
                    np.add.at(near, np.maximum(s - (threshold - seed), 0), 1)
                    np.add.at(near, s + 1, -1)
                    use = np.cumsum(near[:-1]) > 0
                    use[max(0, n - threshold + 1) :] = False
                    inside = T.whole(w.offsets, threshold, n)
                    use[: len(inside)] &= inside
                    for step in reversed(steps[1:]):
                        use[step:] |= use[:-step].copy()
                    at = np.flatnonzero(use)
                    owner = np.searchsorted(w.offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[at].view(np.int64)), pa.array(g[at + steps[0]].view(np.int64)), pa.array(did[lo + owner]), pa.array(th[lo + owner]), pa.array((at - w.offsets[owner]).astype(np.int32))],
                        ["a", "b", *_PLACE],
                    )


def _columns(b: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


#: pos of a row that tells of a range's first or last group: its pair in a and b, and in did its places there.
_EDGE = -1
_RANKED = "did long, th long, pos int, rank long, first boolean, a long, b long"


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of rows sorted by (a, b, did, th, pos): those whose pair occurs at two places or more, with their rank, and those of
    the first and the last group, which may go on in other ranges; and a row of pos _EDGE for each of these two groups.

    Only the last row is carried from one batch to the next, so a pair of any number of places needs no memory.
    """
    base = TaskContext.get().partitionId() << 40
    names = ("a", "b", *_PLACE)
    carry: list[np.ndarray] | None = None
    carry_equal, carry_start, seen = False, 0, 0
    head: tuple[int, int] | None = None
    n_head = 0

    def out(c: list[np.ndarray], keep: np.ndarray, rank: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c[2][keep]), pa.array(c[3][keep]), pa.array(c[4][keep]), pa.array(base + rank[keep]), pa.array(first[keep]), none, none], ["did", "th", "pos", "rank", "first", "a", "b"])

    def edge(a: int, b: int, start: int, n: int) -> pa.RecordBatch:
        values = ((n, pa.int64()), (0, pa.int64()), (_EDGE, pa.int32()), (base + start, pa.int64()), (False, pa.bool_()), (a, pa.int64()), (b, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], ["did", "th", "pos", "rank", "first", "a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        c = _columns(b, names)
        if carry is not None:
            c = [np.concatenate([x, y]) for x, y in zip(carry, c)]
        same = np.ones(len(c[0]), bool)
        same[0] = False
        pair = same.copy()
        for k, x in enumerate(c):
            differ = x[1:] != x[:-1]
            same[1:] &= ~differ
            if k < 2:
                pair[1:] &= ~differ
        if same.any():
            c, pair = [x[~same] for x in c], pair[~same]
        n = len(c[0])
        # Numbers of rows count from the range's first; the carried row has been counted.
        at = np.arange(n) + (seen - 1 if carry is not None else 0)
        seen = int(at[-1]) + 1
        start = np.where(pair, 0, at)
        first = ~pair
        if carry is not None:
            pair[0], start[0], first[0] = carry_equal, carry_start, not carry_equal
        start = np.maximum.accumulate(start)
        if head is None:
            head = (int(c[0][0]), int(c[1][0]))
        n_head = max(n_head, int(at[start == 0].max()) + 1 if start[0] == 0 else 0)
        keep = pair | (start == 0)
        keep[:-1] |= pair[1:]
        keep[-1] = False
        yield out(c, keep, start, first)
        carry, carry_equal, carry_start = [x[-1:] for x in c], bool(pair[-1]), int(start[-1])
    if carry is not None:
        yield out(carry, np.ones(1, bool), np.array([carry_start]), np.array([not carry_equal]))
        yield edge(*head, 0, n_head)
        if carry_start:
            yield edge(int(carry[0][0]), int(carry[1][0]), carry_start, seen - carry_start)


def whole_groups(edges: DataFrame) -> DataFrame:
    """Of (rank, a, b, n), the ranges' first and last groups: rank, the rank of the whole group, and its places.

    A pair lies in ranges that follow each other, so its edges are all of its group. Two rows a range at most.
    """
    groups = edges.groupBy("a", "b").agg(F.min("rank").alias("whole"), F.sum("n").alias("n"))
    return edges.select("rank", "a", "b").join(groups, ["a", "b"]).select("rank", "whole", "n")


def _ranked(pairs: DataFrame) -> DataFrame:
    """(did, th, pos, rank, first) of the places whose pair occurs twice. Written; pairs, a written table, is dropped."""
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() * 36 // SORT_BYTES))
    order = ("a", "b", *_PLACE)
    ranges = written(map_arrow(pairs.repartitionByRange(parts, *order).sortWithinPartitions(*order), _reranked, _RANKED), "ranges")
    drop_written(pairs)
    release(spark)
    whole = written(whole_groups(ranges.where(f"pos = {_EDGE}").select("rank", "a", "b", F.col("did").alias("n"))), "edges")
    places = ranges.where("pos >= 0").join(checked_broadcast(whole, 24), "rank", "left").where("n is null or n > 1")
    out = places.select(*_PLACE, F.coalesce("whole", "rank").alias("rank"), (F.col("first") & F.expr("whole is null or whole = rank")).alias("first"))
    out.shared_path = (ranges.shared_path, whole.shared_path)
    return out


class _Paired:
    """Of rows sorted by (did, th, pos): the pair of the rank here and the rank so many words on, where both are left."""

    def __init__(self, step: int):
        self.step = step

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = self.step
        carry: list[np.ndarray] | None = None
        names = (*_PLACE, "rank")

        def pairs(c: list[np.ndarray], upto: int) -> pa.RecordBatch:
            did, th, pos, rank = c
            doc = np.cumsum(np.r_[False, (did[1:] != did[:-1]) | (th[1:] != th[:-1])]).astype(np.int64) << 32
            key = doc + pos
            to = np.searchsorted(key, key[:upto] + step)
            hit = np.flatnonzero((to < len(key)) & (key[np.minimum(to, len(key) - 1)] == key[:upto] + step))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank[hit], rank[to[hit]], did[hit], th[hit], pos[hit])], ["a", "b", *_PLACE])

        for b in batches:
            if not b.num_rows:
                continue
            c = _columns(b, names)
            if carry is not None:
                c = [np.concatenate([x, y]) for x, y in zip(carry, c)]
            # The partner of a row is at most step rows later.
            upto = max(0, len(c[0]) - step)
            yield pairs(c, upto)
            carry = [x[upto:] for x in c]
        if carry is not None and len(carry[0]):
            yield pairs(carry, len(carry[0]))


class _Runs:
    """Of rows sorted by (did, th, pos): runs of words covered by passages, all (removed false) and without first occurrences (true)."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[bool, tuple[int, int, int, int] | None] = {False: None, True: None}

        def out(rows: list[np.ndarray], removed: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, t)) for x, t in zip(rows, (np.int64, np.int64, np.int32, np.int32))), pa.array(np.full(len(rows[0]), removed))], ["did", "th", "start", "stop", "removed"])

        for b in batches:
            did, th, pos, first = _columns(b, ("did", "th", "pos", "first"))
            for removed in (False, True):
                d, t, p = (x[~first] for x in (did, th, pos)) if removed else (did, th, pos)
                if not len(d):
                    continue
                if last := open_[removed]:
                    d, t, p = np.r_[last[0], d], np.r_[last[1], t], np.r_[np.int64(last[3]), p]
                new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] - p[:-1] > self.threshold)]
                at = np.flatnonzero(new)
                begin, end = p[at].astype(np.int64), p[np.r_[at[1:], len(p)] - 1].astype(np.int64)
                if last:
                    begin[0] = last[2]
                yield out([d[at][:-1], t[at][:-1], begin[:-1], end[:-1] + self.threshold], removed)
                open_[removed] = (int(d[-1]), int(t[-1]), int(begin[-1]), int(end[-1]))
        for removed, last in open_.items():
            if last:
                yield out([np.array([x]) for x in (last[0], last[1], last[2], last[3] + self.threshold)], removed)


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*_PLACE)


def _blocks(docs: DataFrame, columns: list[str]) -> DataFrame:
    """uid, did, th, check, n (words) and the struct row of columns and text, of each row of docs. Written."""
    text = F.coalesce(docs["text"], F.lit(""))
    kept = F.struct(*[docs[c] for c in columns])
    n = F.size(F.array_remove(F.split(text, T.SPACED_GAP), ""))
    return stored(docs.select(did(docs["doc_id"]).alias("did"), th(docs["text"]).alias("th"), F.crc32(text.cast("binary")).alias("check"), n.alias("n"), kept.alias("row")), "documents")


def _runs(rows: DataFrame, threshold: int) -> DataFrame:
    """(did, th, start, stop, removed) runs of words of documents in blocks. Written."""
    spark, steps = rows.sparkSession, rounds(threshold)[1]
    ids = rows.select("uid", *KEY, "check", "n")
    same = ["th", "check"]
    twins = ids.groupBy(*same).agg(F.min(F.struct("did", "uid")).alias("rep"), F.max("did").alias("other"), F.count("*").alias("k")).where("k > 1")
    twins = written(twins.select(*same, F.col("rep.did").alias("rep"), F.col("rep.uid").alias("rep_uid"), F.expr("rep.did <> other").alias("whole")), "twins")
    member = written(ids.join(checked_broadcast(twins, 40), same), "twin_rows")
    copies = send(member.where("uid <> rep_uid").select("uid"), "twin_copies")
    texts = rows.select("uid", *KEY, F.coalesce("row.text", F.lit("")).alias("text"))
    seeds = _ranked(written(map_arrow(texts, _Seeds(threshold, copies), _POSITIONS), "seed_places"))
    alone = ids.join(checked_broadcast(member.where("uid <> rep_uid").select("uid"), 8), "uid", "left_anti").select(*KEY, "uid")
    sent = send(seeds.select(*_PLACE).join(alone, [*KEY]).select("uid", "pos"), "seeds")
    drop_written(seeds)
    delete(spark, copies)
    pairs = written(map_arrow(texts, _Candidates(threshold, sent), _POSITIONS), "pairs")
    delete(spark, sent)
    found = _ranked(pairs)
    for step in steps[1:]:
        pairs = written(map_arrow(_by_document(found.drop("first")), _Paired(step), _POSITIONS), "pairs")
        drop_written(found)
        release(spark)
        found = _ranked(pairs)
    covers = written(map_arrow(_by_document(found.drop("rank")), _Runs(threshold), "did long, th long, start int, stop int, removed boolean"), "runs")
    drop_written(found)
    # A document with identical copies is repeated as a whole, and each copy but the first is removed as a whole.
    whole = member.where("whole").where(F.col("n") >= threshold).select(*KEY, "rep", "n").distinct()
    covered = whole.select(*KEY, F.lit(0).alias("start"), F.col("n").alias("stop"), F.lit(False).alias("removed"))
    gone = whole.where("did <> rep").select(*KEY, F.lit(0).alias("start"), F.col("n").alias("stop"), F.lit(True).alias("removed"))
    # Removed runs of a first copy remain; its other runs lie in the whole.
    rest = covers.join(whole.select(*KEY, F.lit(True).alias("has_copy")), [*KEY], "left").where("has_copy is null or removed").drop("has_copy")
    out = written(rest.unionByName(covered).unionByName(gone), "repeats")
    drop_written(twins, member, covers)
    release(spark)
    return out


def repeated_passages(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and removed of each run."""
    rows = _blocks(docs, ["text"])
    out = _runs(rows, threshold)
    drop_written(rows)
    return out.select(doc_id(), F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"), "removed")


class _Cut:
    """The rows of blocks without the words that were sent; rows left without a word go."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Side(self.path, "start", "stop")
        for batch in batches:
            for b, (begin, end), (start, stop) in side.cut(batch):
                row = b.column("row")
                names = [f.name for f in row.type]
                columns = dict(zip(names, row.flatten()))
                hit = np.flatnonzero(end > begin)
                if len(hit):
                    made = [self.text(columns["text"][i], start[begin[i] : end[i]], stop[begin[i] : end[i]]) for i in hit.tolist()]
                    mask = np.zeros(b.num_rows, bool)
                    mask[hit] = True
                    columns["text"] = pc.replace_with_mask(columns["text"], pa.array(mask), pa.array(made, columns["text"].type))
                    if "n_chars" in columns and (pa.types.is_integer(columns["n_chars"].type) or pa.types.is_floating(columns["n_chars"].type)):
                        columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], pa.array(mask), pa.array([None if t is None else len(t) for t in made], columns["n_chars"].type))
                    mask[hit] = [t is None for t in made]
                    keep = pa.array(np.flatnonzero(~mask))
                    columns = {k: c.take(keep) for k, c in columns.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    @staticmethod
    def text(text: pa.Scalar, start: np.ndarray, stop: np.ndarray) -> str | None:
        """What stays keeps its white space, which goes with the word before it. None if no word stays."""
        w = T.words(pa.array([text.as_py()], pa.string()), T.SPACED)
        places = np.r_[w.starts, len(w.data)]
        if (stop - start).sum() >= len(w.starts):
            return None
        lo, out = 0, []
        for x, y in zip(places[start].tolist(), places[stop].tolist()):
            out.append(w.data[lo:x].tobytes())
            lo = y
        return b"".join([*out, w.data[lo:].tobytes()]).decode()


def cut(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, without the removed runs; a document left without a word goes.

    What stays keeps its white space. n_chars, if docs has it as a number, counts the new text of a row that was cut. Written.
    """
    spark, rows = docs.sparkSession, _blocks(docs, docs.columns)
    found = _runs(rows, threshold)
    gone = found.where("removed").select(*KEY, "start", "stop")
    sent = send(gone.join(rows.select(*KEY, "uid"), [*KEY]).select("uid", "start", "stop"), "cuts")
    kept = written(map_arrow(rows.select("uid", "row"), _Cut(sent), docs.schema), "cut_documents")
    drop_written(found, rows)
    delete(spark, sent)
    return kept


def runs_sql(docs: str = "documents", threshold: int = THRESHOLD) -> str:
    """The same runs as DuckDB SQL, by the passages' text."""
    return rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '{T.SPACED_GAP}'), lambda x: x <> '') as ws from {docs}),
g as (select doc_id, unnest(range(0, len(ws) - {threshold - 1})) as pos, unnest(list_transform(range(0, len(ws) - {threshold - 1}), lambda i: md5(array_to_string(ws[i + 1:i + {threshold}], ' ')))) as h
  from w where len(ws) >= {threshold}),
r as (select doc_id, pos, count(*) over (partition by h) as n, row_number() over (partition by h order by doc_id, pos) as k from g),
o as (select doc_id, pos, false as removed from r where n > 1 union all select doc_id, pos, true from r where n > 1 and k > 1),
s as (select *, (coalesce(pos - lag(pos) over (partition by doc_id, removed order by pos), 1000000) > {threshold})::int as new from o),
i as (select *, sum(new) over (partition by doc_id, removed order by pos) as run from s)
select doc_id, min(pos) as start_word, max(pos) + {threshold} as end_word, removed from i group by doc_id, removed, run"""
