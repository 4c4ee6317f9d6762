"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the sign of a sum of +-1 vectors over a text's distinct words
(lower case, letters and digits), 128 bits. Edited copies in which a tenth of
the words changed differ in some 20 bits, so that no split of the bits into
bands finds them exactly at less than quadratic cost. Candidates therefore come
from blocks of texts that agree in two minimum hashes of their word 3-grams
(BANDS such pairs); within a block all pairs are compared.

The comparison is vertical: bit k of all fingerprints of a partition lies in one
plane of 64-bit words, in block order. Comparing every fingerprint with the one
d places later is an XOR of each plane with itself shifted by d; carry-save
adders count the differing bits of 64 pairs at once, and words all of whose
lanes are beyond the radius (or joined already, or in different blocks) are
abandoned after each group of planes.

Texts of equal fingerprints and block keys are one kind, counted before any
shuffle, so a thousand copies enter as one: its least document. Kinds of equal
fingerprints are linked, kinds within the radius too, and linked kinds are joined
to groups by min-label propagation with pointer jumping over written tables. Only
then do the copies look up their kind's group; no group of copies is held in one
row or task. The document with the least doc_id of a group stays.

Defined results: a null text counts as empty; texts without a word are equal
only to texts that are equal; very long texts count with all their words; repeated
rows (same doc_id and text) are one document; ties in doc_id are broken by the hash
of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import checked_broadcast, drop_written, written
from corpusmith.functions.ship import map_arrow

from . import textops as T
from .entities import KEY, doc_id, keyed, packed

BITS, RADIUS, BANDS, SHINGLE, PER_BAND = 128, 24, 16, 3, 2
#: Fingerprints of one block that one task compares; a larger block is compared tile by tile.
TILE = 1 << 15

_SEEDS = T.mix(np.arange(1, BANDS * PER_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = T.mix(_SEEDS) | np.uint64(1)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2) words of fingerprint and (texts, BANDS) block keys."""
    fp, keys = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros((len(texts), BANDS), np.uint64)
    for lo, hi in T.slices(texts, 1 << 20):
        w = T.words(texts[lo:hi], T.ALNUM)
        h = T.word_hashes(w)
        n = w.lengths()
        used = np.flatnonzero(n)
        if not len(used):
            continue
        owner = w.owner()
        order = np.lexsort((h, owner))
        oh, oo = h[order], owner[order]
        first = np.ones(len(oh), bool)
        first[1:] = (oh[1:] != oh[:-1]) | (oo[1:] != oo[:-1])
        dh, do = oh[first], oo[first]
        at = np.flatnonzero(np.r_[True, do[1:] != do[:-1]])
        count = np.diff(np.r_[at, len(do)])
        for k in range(BITS // 64):
            each = T.mix(dh + np.uint64(k * 0x632BE59BD9B4E019 % 2**64))
            ones = np.add.reduceat(np.unpackbits(each.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int32)
            fp[lo + used, k] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        # A text shorter than a shingle is one shingle as a whole.
        grams = T.ngram_hashes(h, SHINGLE)
        inside = T.whole(w.offsets, SHINGLE, len(h))
        g, g_owner = grams[inside], owner[: len(grams)][inside]
        brief = used[n[used] < SHINGLE]
        if len(brief):
            whole = np.add.reduceat(h * np.uint64(3) + np.uint64(1), w.offsets[:-1][brief])
            whole = np.where(n[brief] == 1, h[w.offsets[:-1][brief]], whole)
            g, g_owner = np.r_[g, whole], np.r_[g_owner, brief]
            by = np.argsort(g_owner, kind="stable")
            g, g_owner = g[by], g_owner[by]
        at = np.flatnonzero(np.r_[True, g_owner[1:] != g_owner[:-1]])
        rows = lo + g_owner[at]
        for b in range(BANDS):
            key = np.full(len(at), b, np.uint64)
            for s in range(b * PER_BAND, (b + 1) * PER_BAND):
                # Multiply-shift families of an already mixed hash; the minimum is mixed again into the key.
                key = T.mix(key * np.uint64(31) + np.minimum.reduceat((g ^ _SEEDS[s]) * _ODD[s], at))
            keys[rows, b] = key
    return fp, keys


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """did, th, f0, f1, and the block keys of each document that has a word, written."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys = fingerprints(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), lists], ["did", "th", "f0", "f1", "keys"])

    lowered = keyed(docs).withColumn("text", F.lower("text"))
    return written(map_arrow(lowered, go, "did long, th long, f0 long, f1 long, keys array<long>"), "fingerprints")


def _shifted(planes: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """Words at of each plane moved by d places towards the start. planes has spare words at its end."""
    q, s = divmod(d, 64)
    low = planes[:, at + q]
    return low if not s else (low >> np.uint64(s)) | (planes[:, at + q + 1] << np.uint64(64 - s))


def _add(counters: list[np.ndarray], x: np.ndarray, weight: int) -> None:
    """Adds bits x, each worth 2^weight, to counters held one bit a plane."""
    k = weight
    while True:
        if k == len(counters):
            counters.append(x)
            return
        counters[k], x = counters[k] ^ x, counters[k] & x
        k += 1
        if not x.any():
            return


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three planes of bits."""
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Which lanes count more than radius: a comparison from the highest bit down."""
    over, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        bit = counters[k] if k < len(counters) else np.zeros_like(over)
        if radius >> k & 1:
            same &= bit
        else:
            over |= same & bit
            same &= ~bit
    return over


def within(planes: np.ndarray, at: np.ndarray, active: np.ndarray, d: int, radius: int, group: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Words of lanes (at, bits) of those active whose fingerprints, d places apart, differ in at most radius bits."""
    counters: list[np.ndarray] = [np.zeros_like(active) for _ in range(3)]
    for lo in range(0, len(planes), group):
        block = planes[lo : lo + group]
        x = list(block[:, at] ^ _shifted(block, at, d))
        x += [np.zeros_like(active)] * (group - len(x))
        # Seven planes make one plane each of ones, twos and fours.
        s1, c1 = _full(x[0], x[1], x[2])
        s2, c2 = _full(x[3], x[4], x[5])
        ones, c3 = _full(s1, s2, x[6])
        twos, fours = _full(c1, c2, c3)
        for weight, bits in enumerate((ones, twos, fours)):
            _add(counters, bits, weight)
        if lo + group > radius:
            active = active & ~_beyond(counters, radius)
            left = np.flatnonzero(active)
            if not len(left):
                return at[:0], active[:0]
            if len(left) < len(at):
                at, active, counters = at[left], active[left], [c[left] for c in counters]
    return at, active


def _planes(fp: np.ndarray, words: int) -> np.ndarray:
    """fp (n, 2) as BITS planes of so many words of 64 fingerprints."""
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(fp)] = np.unpackbits(np.ascontiguousarray(fp).astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def joined(key: np.ndarray, fp: np.ndarray, tile: np.ndarray | None = None, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by key: the first row of the group to which each belongs, by pairs of one key within the radius.

    tile: of a block that is compared in parts, 0 or 1; only pairs of different tiles are then compared.
    """
    n = len(key)
    label = np.arange(n)
    if n < 2:
        return label
    words = n // 64 + 2
    planes = _planes(fp, 2 * words + 2)
    d, rows = 1, np.arange(n - 1)
    while True:
        rows = rows[rows < n - d]
        rows = rows[key[rows] == key[rows + d]]
        if not len(rows):
            return label
        # Lanes whose two ends are joined already need no comparison.
        open_ = rows[label[rows] != label[rows + d]]
        if tile is not None and len(open_):
            open_ = open_[tile[open_] != tile[open_ + d]]
        if len(open_):
            flags = np.zeros(n, bool)
            flags[open_] = True
            active = _lanes(flags, words)
            at = np.flatnonzero(active)
            at, hit = within(planes, at, active[at], d, radius)
            if len(at):
                bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(bits)
                a = at[r] * 64 + c
                for x, y in zip(a, a + d) if len(a) < 64 else ():
                    lx, ly = label[x], label[y]
                    if lx != ly:
                        label[label == max(lx, ly)] = min(lx, ly)
                if len(a) >= 64:
                    label = _merge(label, a, a + d)
        d += 1


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b) are joined, least label wins."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        lo, hi = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        parent = np.arange(len(label))
        np.minimum.at(parent, hi, lo)
        label = _roots(parent)[label]


def _blocks(kept: DataFrame, tile: int) -> DataFrame:
    """One row a document and block: part tells apart what a task compares, side the two tiles of a part (null: one tile)."""
    rows = kept.select(*KEY, "f0", "f1", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    # A block beyond the tile size is hashed into t tiles; each tile meets itself and every other one in parts of their own.
    hot = sizes.where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    placed = rows.join(hot, "key", "left")
    usual = placed.where("t is null").select("key", F.lit(0).alias("part"), F.lit(None).cast("int").alias("side"), *KEY, "f0", "f1")
    own = F.pmod(F.xxhash64("did", "th"), F.col("t")).cast("int")
    tiled = placed.where("t is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    split = tiled.select("key", (low * F.col("t") + high + 1).alias("part"), F.when(low != high, (F.col("own") == low).cast("int")).alias("side"), *KEY, "f0", "f1")
    return usual.unionByName(split)


def _compare(radius: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            key, part = (col[c].to_numpy(zero_copy_only=False) for c in ("key", "part"))
            new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            block = np.cumsum(new)
            size = np.bincount(block)[block]
            use = np.flatnonzero(size > 1)
            did, th, f0, f1 = (col[c].to_numpy(zero_copy_only=False)[use] for c in ("did", "th", "f0", "f1"))
            # Rows without a side meet every other; in a part of two tiles only those of different sides.
            side = col["side"].fill_null(-1).to_numpy(zero_copy_only=False)[use]
            fp = np.stack([f0, f1], 1).view(np.uint64)
            label = np.arange(len(use))
            for tiles in (False, True):
                which = np.flatnonzero((side >= 0) == tiles)
                if len(which):
                    label[which] = which[joined(block[use][which], fp[which], side[which] if tiles else None, radius)]
            moved = np.flatnonzero(label != np.arange(len(use)))
            to = label[moved]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (did[moved], th[moved], did[to], th[to])], ["did", "th", "did2", "th2"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 18:
                # All but the last block, which may go on in the next batch.
                table = pa.Table.from_batches(held)
                key, part = (table.column(c).to_numpy() for c in ("key", "part"))
                ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
                if len(ends):
                    cut = int(ends[-1]) + 1
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    return go


_KIND = ["f0", "f1", "kh"]


def _kinds(prints: DataFrame) -> DataFrame:
    """One row a kind: f0, f1, kh (a hash of keys, or of the text where it has no word), keys, its least document and n of them. Written."""
    hashed = prints.withColumn("kh", _kind_hash())
    return written(hashed.groupBy(*_KIND).agg(F.min(F.struct(*KEY)).alias("least"), F.min("keys").alias("keys"), F.count("*").alias("n")), "kinds")


def _kind_hash() -> Column:
    return F.when(F.col("keys")[0] == 0, F.col("th")).otherwise(F.xxhash64("keys"))


def pair_table(kinds: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (did, th, did2, th2) that join all kinds of equal fingerprints, and with pairs within the radius in blocks, to groups. Written."""
    worded = kinds.where("keys[0] <> 0")
    several = worded.groupBy("f0", "f1").agg(F.min("least").alias("to"), F.count("*").alias("k")).where("k > 1").drop("k")
    same = worded.select("f0", "f1", "least").join(several, ["f0", "f1"]).where("least <> to").select("least.did", "least.th", F.col("to.did").alias("did2"), F.col("to.th").alias("th2"))
    kept = worded.select("least.*", "f0", "f1", "keys")
    near = map_arrow(_blocks(kept, tile).repartition("key", "part").sortWithinPartitions("key", "part", *KEY), _compare(radius), "did long, th long, did2 long, th2 long")
    return written(near.distinct().unionByName(same), "links")


def components(links: DataFrame) -> DataFrame:
    """(did, th, did2, th2) with (did2, th2) the least document of each one's group; the least itself is left out. Written.

    Each round points every node at the least neighbour (large star, then small star); rounds grow with the logarithm of the longest chain.
    """
    a, b = F.struct(*KEY), F.struct(F.col("did2").alias("did"), F.col("th2").alias("th"))
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: greater neighbours of each node go to its least neighbour or itself.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "edges")
        changed = after.join(edges, ["u", "v"], "left_anti").isEmpty() is False or after.count() != edges.count()
        drop_written(edges)
        edges = after
        if not changed:
            out = written(edges.select("u.did", "u.th", F.col("v.did").alias("did2"), F.col("v.th").alias("th2")), "groups")
            drop_written(edges)
            return out


def grouped(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(did, th, did2, th2) of the documents of prints that go, each with the document of its group that stays. Written."""
    kinds = _kinds(prints)
    links = pair_table(kinds, radius, tile)
    roots = components(links)
    # What is more than one document takes its kind's group; the kinds' least documents have it from the links.
    copied = written(kinds.where("n > 1").select(*_KIND, F.col("least.did").alias("kd"), F.col("least.th").alias("kt")), "copied")
    members = prints.select(*KEY, "f0", "f1", _kind_hash().alias("kh")).join(checked_broadcast(copied, 64), _KIND).where("did <> kd or th <> kt")
    of = roots.select(F.col("did").alias("kd"), F.col("th").alias("kt"), "did2", "th2")
    to = members.distinct().join(of, ["kd", "kt"], "left").select(*KEY, F.coalesce("did2", "kd").alias("did2"), F.coalesce("th2", "kt").alias("th2"))
    out = written(roots.unionByName(to), "near_duplicates")
    drop_written(kinds, links, roots, copied)
    return out


def groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(did, th, did2, th2): each document that goes, and the document of its group that stays. Written."""
    prints = fingerprint_table(docs)
    out = grouped(prints, radius, tile)
    drop_written(prints)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id of each document that goes, with kept_doc_id, the one of its group that stays. drop_written of it drops the groups."""
    g = groups(docs, radius)
    out = g.select(doc_id(), F.when(F.col("did2") != F.lit(-(1 << 63)), F.col("did2")).alias("kept_doc_id"))
    out.shared_path = g.shared_path
    return out


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, without those that go; of repeated rows one stays. drop_written of it drops the groups."""
    gone = groups(docs, radius)
    rows = packed(docs)
    twice = written(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated_rows")
    left = rows.join(checked_broadcast(gone.select(*KEY), 16), [*KEY], "left_anti")
    once = left
    if twice.isEmpty():
        drop_written(twice)
    else:
        again = checked_broadcast(twice, 16)
        once = left.join(again, [*KEY], "left_anti").unionByName(left.join(again, [*KEY], "left_semi").dropDuplicates([*KEY]))
    out = once.select("row.*")
    out.shared_path = gone.shared_path
    return out
