import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import simhash as S

from .fixtures import awkward, clashing, documents, empty


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


def brute(docs, radius=S.RADIUS):
    """All pairs of fingerprints."""
    rows = S.fingerprint_table(docs).where("keys[0] <> 0").select("did", "f0", "f1").toPandas()
    fp, ids = rows[["f0", "f1"]].to_numpy().view(np.uint64), rows.did.tolist()
    return [(ids[i], ids[i + 1 + j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= radius)], ids


@pytest.mark.parametrize("n", [2, 63, 64, 65, 500])
@pytest.mark.parametrize("radius", [0, 3, 24, 40])
def test_bit_sliced_comparison_is_exact(n, radius):
    rng = np.random.default_rng(n + radius)
    base = rng.integers(0, 1 << 63, (max(1, n // 6), 2), dtype=np.int64).view(np.uint64)
    fp = base[rng.integers(0, len(base), n)].copy()
    for _ in range(30):
        row, word, bit = rng.integers(0, n, n), rng.integers(0, 2, n), rng.integers(0, 64, n).astype(np.uint64)
        fp[row, word] ^= np.uint64(1) << bit
    key = np.sort(rng.integers(0, max(1, n // 20), n))
    planes, words = S._planes(fp, 2 * (n // 64 + 2) + 2), n // 64 + 2
    for d in (1, 2, 63, 64, 65, n - 1):
        if d < n:
            active = S._lanes(np.ones(n - d, bool), words)
            at, hit = S.within(planes, np.flatnonzero(active), active[np.flatnonzero(active)], d, radius)
            got = {int(a) * 64 + b for a, h in zip(at, hit) for b in range(64) if int(h) >> b & 1}
            assert got == {i for i in range(n - d) if np.bitwise_count(fp[i] ^ fp[i + d]).sum() <= radius}
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= radius]
    want = groups_of(pairs, range(n))
    label = S.joined(key, fp, radius=radius)
    assert {i: int(label[i]) for i in range(n) if label[i] != i} == want


def test_tiles_meet_each_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" extra words"))))
    prints = S.fingerprint_table(docs)
    one = {(r.did, r.did2) for r in S.grouped(prints).collect()}
    many = {(r.did, r.did2) for r in S.grouped(prints, tile=3).collect()}
    assert one == many and len(one) >= 200 * 0.9


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs, _ = brute(docs)
    got = {r.doc_id: r.kept_doc_id for r in S.near_duplicates(docs).collect()}
    found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)
    assert not {*got} - {*groups_of(pairs, [x for p in pairs for x in p])}


def edited(words, rng, share):
    return " ".join(rng.choice(("alpha", "beta", "gamma")) if rng.random() < share else w for w in words)


def test_copies_are_caught_and_others_left(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}q" for i in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(base[k % 10]) for k in range(30)] + [edited(base[20 + k % 10], rng, 0.05) for k in range(30)]
    got = {r.doc_id: r.kept_doc_id for r in S.near_duplicates(documents(spark, texts)).collect()}
    assert all(got[40 + k] == k % 10 for k in range(30))
    assert sum(got.get(70 + k) == 20 + k % 10 for k in range(30)) >= 29
    assert not {*got} & {*range(40)}


def test_a_chain_is_one_group(spark):
    links = spark.createDataFrame([(i, 0, i + 1, 0) for i in range(40)] + [(100, 0, 100, 0), (201, 1, 200, 5)], "did long, th long, did2 long, th2 long")
    assert {(r.did, r.did2) for r in S.components(links).collect()} == {(i, 0) for i in range(1, 41)} | {(201, 200)}
    assert S.components(links.where("false")).count() == 0


def test_awkward_rows(spark):
    for docs in (awkward(spark), clashing(awkward(spark))):
        kept = S.keep_one(docs)
        assert kept.columns == docs.columns
        ids = sorted((r.doc_id if r.doc_id is not None else -1, r.text is None) for r in kept.collect())
        # The repeated row is once there; null, empty and blank texts are copies of each other only if equal.
        assert [i for i, _ in ids].count(4) == 1 and {0, 3, 4, 5, 6, 7} <= {i for i, _ in ids}
    assert S.keep_one(empty(spark)).count() == S.near_duplicates(empty(spark)).count() == 0


def test_texts_without_a_word_and_short_ones(spark):
    docs = documents(spark, ["", None, "!!", "??", "a", "a", "b", "a b", "a b", "b a"])
    got = {r.doc_id: r.kept_doc_id for r in S.near_duplicates(docs).collect()}
    # Empty and null are the same text; signs without a word are equal only to themselves.
    assert got[1] == 0 and got[5] == 4 and got[8] == 7 and not {2, 3, 4, 6} & {*got}


def test_fingerprints_by_brute_force():
    """Word hashes, signs of sums and minimum hashes again, one text at a time."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m64
        x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 & m64
        return x ^ x >> 33

    def word(b):
        h = mix(int.from_bytes(b[:8], "little") + len(b) * 0x9E3779B97F4A7C15 & m64)
        for i in range(8, len(b), 8):
            h = mix(h * 0x9E3779B97F4A7C15 + int.from_bytes(b[i : i + 8], "little") & m64)
        return h

    base = 0x5851F42D4C957F2D | 1
    gram = lambda hs: mix(sum(h * pow(base, i, 1 << 64) for i, h in enumerate(hs)) & m64)
    seeds = [mix(i * 0x9E3779B97F4A7C15 & m64) for i in range(1, S.BANDS * S.PER_BAND + 1)]
    odd = [mix(x) | 1 for x in seeds]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "a", "extraordinarily", "antidisestablishmentarian"]) + str(rng.randint(0, 30)) for _ in range(n)) for n in (3, 4, 17, 90)]
    fp, keys = S.fingerprints(pa.array(texts))
    for k, text in enumerate(texts):
        hs = [word(w.encode()) for w in text.split()]
        kinds = set(hs)
        for half in range(S.BITS // 64):
            each = [mix(h + half * 0x632BE59BD9B4E019 & m64) for h in kinds]
            assert int(fp[k, half]) == sum((2 * sum(x >> bit & 1 for x in each) > len(kinds)) << bit for bit in range(64))
        grams = [gram(hs[i : i + S.SHINGLE]) for i in range(len(hs) - S.SHINGLE + 1)]
        for b in range(S.BANDS):
            key = b
            for s in range(b * S.PER_BAND, (b + 1) * S.PER_BAND):
                key = mix(key * 31 + min((g ^ seeds[s]) * odd[s] & m64 for g in grams) & m64)
            assert int(keys[k, b]) == key


def test_many_copies_are_no_one_row(spark):
    """Half of all rows are one text, and a tenth near copies of it."""
    words = [f"w{i}q" for i in range(120)]
    rng = random.Random(1)
    texts = [" ".join(words)] * 3000 + [edited(words, rng, 0.03) for _ in range(600)] + [" ".join(rng.sample(words, 100)) for _ in range(50)]
    docs = documents(spark, texts)
    prints = S.fingerprint_table(docs)
    kinds = S._kinds(prints)
    assert kinds.agg(F.sum("n")).first()[0] == len(texts) and kinds.agg(F.max("n")).first()[0] >= 3000
    got = {r.doc_id: r.kept_doc_id for r in S.near_duplicates(docs).collect()}
    assert all(got[k] == 0 for k in range(1, 3000)) and sum(got.get(k) == 0 for k in range(3000, 3600)) >= 590
