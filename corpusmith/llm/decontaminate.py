"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are sets of shingles of SHINGLE words (lower case, letters
and digits; an item of fewer words is one shingle of all of them). A document
is contaminated by an item if some window of the item's number of words holds
at least THRESHOLD of the item's distinct shingles.

1. Document places whose shingle is any item's: one pass; the items' shingle
   hashes go to the executors if their counted size allows, else they are joined.
2. Rarity: each shingle's number of documents, over all documents.
3. Prefix: an item of s shingles that must share c = ceil(THRESHOLD * s) needs
   one of its s - c + 1 rarest in the window, so only those are joined.
4. Bounds: a document needs c shingles in all (length), and c of the item's
   within a window's reach on both sides of a joined place (position). Only the
   pairs of document and item that the prefixes joined go on from here.
5. Verification: every window that begins at one of the item's places and holds
   a joined one; its distinct shingles are counted exactly.

Defined results: null or wordless items and documents match nothing; a window
ends at the document's end, so a document shorter than the item is one window;
items of equal texts give a row each (distinct item_id), rows of one item_id are one
item of all their shingles; an item without an id matches nothing; a document without
one is found with a null doc_id; repeated rows of documents are one document; very
long texts are searched whole; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import BROADCAST_BYTES, checked_broadcast, drop_written, written
from corpusmith.functions.ship import map_arrow

from . import textops as T
from .entities import KEY, doc_id, keyed, packed

SHINGLE, THRESHOLD = 5, 0.8


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, number of words, shingle length and hash of each place of each item."""
    for b in batches:
        w = T.words(b.column("text"), T.ALNUM)
        h, n, ids = T.word_hashes(w), w.lengths(), b.column("item_id").to_numpy(zero_copy_only=False)
        for k in range(1, SHINGLE + 1):
            g = T.ngram_hashes(h, k)
            at = np.flatnonzero(T.whole(w.offsets, k, len(h)))
            owner = np.searchsorted(w.offsets, at, "right") - 1
            mine = (n[owner] == k) if k < SHINGLE else (n[owner] >= k)
            at, owner = at[mine], owner[mine]
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(n[owner]), pa.array(np.full(len(at), k, np.int32)), pa.array(g[at].view(np.int64))], ["item_id", "n_words", "k", "h"])


class _Places:
    """Places of a document's shingles: those in wanted, or all of them if wanted is None."""

    def __init__(self, lengths: list[int], wanted: dict[int, np.ndarray] | None):
        self.lengths, self.wanted = lengths, wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, marks = self.wanted, {}
        if wanted is not None:
            for k, hashes in wanted.items():
                # A bitmap of some low bits lets nearly all places go before the exact search.
                bits = max(16, min(26, int(len(hashes) * 64).bit_length()))
                marks[k] = (np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool))
                marks[k][1][(hashes & marks[k][0]).astype(np.int64)] = True
        for b in batches:
            texts, did, th = b.column("text"), b.column("did").to_numpy(), b.column("th").to_numpy()
            for lo, hi in T.slices(texts):
                w = T.words(texts[lo:hi], T.ALNUM)
                h = T.word_hashes(w)
                for k in self.lengths:
                    g = T.ngram_hashes(h, k)
                    if wanted is None:
                        at = np.arange(len(g))
                    else:
                        low, bitmap = marks[k]
                        at = np.flatnonzero(bitmap[(g & low).astype(np.int64)])
                        near = np.minimum(np.searchsorted(wanted[k], g[at]), len(wanted[k]) - 1)
                        at = at[wanted[k][near] == g[at]]
                    owner = np.searchsorted(w.offsets, at, "right") - 1
                    ok = at + k <= w.offsets[owner + 1]
                    at, owner = at[ok], owner[ok]
                    room = (w.lengths()[owner] - k + 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(did[lo + owner]), pa.array(th[lo + owner]), pa.array(room), pa.array((at - w.offsets[owner]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(g[at].view(np.int64))], ["did", "th", "room", "pos", "k", "h"])


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(did, th, item_id, n_shared, n_shingles, start): for each contaminated document and item its best window, the first of equals. Written."""
    spark = docs.sparkSession
    texts = items.select(items["item_id"].cast("long").alias("item_id"), F.lower(F.coalesce(items["text"], F.lit(""))).alias("text")).where("item_id is not null")
    raw = map_arrow(texts, _items, "item_id long, n_words long, k int, h long")
    shingles = raw.groupBy("item_id", "k", "h").agg(F.max("n_words").alias("n_words"))
    sizes = raw.groupBy("item_id").agg(F.countDistinct("h").cast("int").alias("s"), (F.max("n_words") - F.max("k") + 1).cast("int").alias("window"))
    sizes = sizes.withColumn("c", F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("s") - 1e-9)).cast("int"))
    item_set = written(shingles.select("item_id", "k", "h").join(sizes, "item_id"), "item_shingles")
    distinct = item_set.select("k", "h").distinct()
    lengths = sorted(r.k for r in item_set.select("k").distinct().collect())
    n = distinct.count()
    wanted = None
    if n * 8 <= limit:
        table = distinct.toArrow()
        k, h = table.column("k").to_numpy(), table.column("h").to_numpy().view(np.uint64)
        wanted = {x: np.sort(h[k == x]) for x in lengths}
    places = map_arrow(keyed(docs).withColumn("text", F.lower("text")), _Places(lengths, wanted), "did long, th long, room int, pos int, k int, h long")
    if wanted is None:
        places = places.join(distinct, ["k", "h"], "left_semi")
    places = written(places.distinct(), "item_places")
    rarity = places.groupBy("k", "h").agg(F.countDistinct(*KEY).alias("df"))
    order = item_set.join(rarity, ["k", "h"], "left").select("item_id", "k", "h", "s", "c", "window", F.coalesce("df", F.lit(0)).alias("df"))
    rank = F.expr("row_number() over (partition by item_id order by df, h)")
    prefix = order.withColumn("rank", rank).where("rank <= s - c + 1").select("item_id", "k", "h")
    prefix = written(prefix, "item_prefixes")
    # The prefix join, with the bound on length.
    joined = places.join(checked_broadcast(prefix, 24), ["k", "h"]).select(*KEY, "item_id", F.col("pos").alias("anchor"), "room")
    anchors = written(joined.groupBy(*KEY, "item_id").agg(F.sort_array(F.collect_set("anchor")).alias("anchors")), "anchors")
    pairs = anchors.select(*KEY, "item_id")
    # Only places of the joined documents are matched with items again, and only joined pairs are grouped.
    of_pairs = places.join(pairs.select(*KEY).distinct(), [*KEY], "left_semi")
    bounded = of_pairs.join(checked_broadcast(item_set, 40), ["k", "h"]).where("room >= c").select(*KEY, "item_id", "pos", "h", "s", "c", "window")
    bounded = bounded.join(pairs, [*KEY, "item_id"], "left_semi")
    grouped = bounded.groupBy(*KEY, "item_id", "s", "c", "window").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("places"))
    both = grouped.where(F.size("places") >= F.col("c")).join(anchors, [*KEY, "item_id"])
    verified = map_arrow(both, _verified, "did long, th long, item_id long, n_shared int, n_shingles int, start int")
    out = written(verified, "contaminated")
    drop_written(item_set, places, prefix, anchors)
    return out


def best_window(pos: np.ndarray, h: np.ndarray, anchors: np.ndarray, window: int, least: int) -> tuple[int, int]:
    """Most distinct h in any window of so many places that begins at one of pos and holds an anchor, and where; (0, -1) if none has least."""
    # The bound on position: places within reach of the nearest anchors.
    stop = np.searchsorted(pos, pos + window)
    held = np.searchsorted(anchors, pos) < np.searchsorted(anchors, pos + window)
    tries = np.flatnonzero(held & (stop - np.arange(len(pos)) >= least))
    best = (0, -1)
    if not len(tries):
        return best
    # Two ends move over the places; counts by shingle make a move constant work.
    _, code = np.unique(h, return_inverse=True)
    code, ends = code.tolist(), stop.tolist()
    count, kinds, lo, hi = [0] * (max(code) + 1), 0, 0, 0
    for i in tries.tolist():
        while hi < ends[i]:
            kinds += count[code[hi]] == 0
            count[code[hi]] += 1
            hi += 1
        while lo < i:
            count[code[lo]] -= 1
            kinds -= count[code[lo]] == 0
            lo += 1
        if kinds > best[0]:
            best = (kinds, int(pos[i]))
    return best if best[0] >= least else (0, -1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        places, anchors = b.column("places"), b.column("anchors")
        flat = places.flatten()
        pos, h = flat.field("pos").to_numpy(), flat.field("h").to_numpy()
        at = np.r_[0, np.cumsum(places.value_lengths().to_numpy())]
        anchor, anchor_at = anchors.flatten().to_numpy(), np.r_[0, np.cumsum(anchors.value_lengths().to_numpy())]
        window, least = b.column("window").to_numpy(), b.column("c").to_numpy()
        found = [best_window(pos[at[i] : at[i + 1]], h[at[i] : at[i + 1]], anchor[anchor_at[i] : anchor_at[i + 1]], int(window[i]), int(least[i])) for i in range(b.num_rows)]
        keep = np.flatnonzero([x[0] > 0 for x in found])
        kept = b.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [kept.column("did"), kept.column("th"), kept.column("item_id"), pa.array([found[i][0] for i in keep], pa.int32()), kept.column("s"), pa.array([found[i][1] for i in keep], pa.int32())],
            ["did", "th", "item_id", "n_shared", "n_shingles", "start"],
        )


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and start_word of the best window. Written; drop_written of it drops it."""
    m = matches(docs, items, threshold)
    out = m.select(doc_id(), "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("start").cast("long").alias("start_word"))
    out.shared_path = m.shared_path
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates. drop_written of it drops the table of those that go."""
    found = matches(docs, items, threshold)
    gone = written(found.select(*KEY).distinct(), "contaminated_documents")
    drop_written(found)
    out = packed(docs).join(checked_broadcast(gone, 16), [*KEY], "left_anti").select("row.*")
    out.shared_path = gone.shared_path
    return out


def contaminated_sql(docs: str = "documents", items: str = "benchmark", threshold: float = THRESHOLD) -> str:
    """The same by trying every window, as DuckDB SQL."""
    toks = lambda t: rf"list_filter(regexp_split_to_array(lower({t}), '{T.ALNUM_GAP}'), lambda x: x <> '')"
    grams = lambda ws, k: f"list_transform(range(0, len({ws}) - {k} + 1), lambda i: array_to_string({ws}[i + 1:i + {k}], ' '))"
    return rf"""
with it as (select item_id, {toks('text')} as ws from {items} where item_id is not null),
i1 as (select item_id, ws, least(len(ws), {SHINGLE}) as k from it where len(ws) > 0),
i2 as (select item_id, k, len(ws) - k + 1 as win, list_distinct({grams('ws', 'k')}) as gs from i1),
i3 as (select item_id, k, win, len(gs) as s, greatest(1, ceil({threshold} * len(gs) - 1e-9))::int as c, unnest(gs) as g from i2),
ks as (select distinct k from i3),
d as (select doc_id, {toks('text')} as ws from {docs}),
dp as (select doc_id, k, unnest(range(0, len(ws) - k + 1)) as pos, unnest({grams('ws', 'k')}) as g from d, ks where len(ws) >= k),
hit as (select doc_id, item_id, pos, dp.g, win, s, c from dp join i3 on dp.k = i3.k and dp.g = i3.g),
w as (select a.doc_id, a.item_id, a.pos, a.s, a.c, count(distinct b.g) as n from hit a join hit b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.pos >= a.pos and b.pos < a.pos + a.win group by all),
r as (select *, row_number() over (partition by doc_id, item_id order by n desc, pos) as k from w where n >= c)
select doc_id, item_id, n as n_shared, s::bigint as n_shingles, pos as start_word from r where k = 1"""
