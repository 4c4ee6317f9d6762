"""Integer codecs of inverted lists, and what lists cost under them.

These encode and decode single lists exactly (64 bits throughout), and give
sizes: var-byte and packed sizes as built-in expressions, simple9 by an Arrow
pass over all lists of a batch side by side, since its words are cut greedily.
corpusmith.operators.blocks holds tables of encoded chunks, blocks and runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import written
from corpusmith.functions.ship import map_arrow
from corpusmith.plans import ranges
from corpusmith.plans.index import CHUNK, FLAT, gathered, numbered

#: Selectors of simple9: items in a word and bits of each.
LAYOUTS = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))
SIMPLE9_LIMIT = 1 << 28


def bit_width(n: int) -> int:
    return n.bit_length()


def varbyte(n: int) -> bytes:
    """Groups of seven bits, low first; the high bit marks the last."""
    if n < 0:
        raise ValueError(f"{n} is negative")
    out = bytearray()
    while n >= 128:
        out.append(n & 127)
        n >>= 7
    out.append(n | 128)
    return bytes(out)


def read_varbyte(data: bytes, at: int = 0) -> tuple[int, int]:
    """A number and the place after it."""
    n = shift = 0
    while not data[at] & 128:
        n |= data[at] << shift
        shift, at = shift + 7, at + 1
    return n | (data[at] & 127) << shift, at + 1


def pack(values: Sequence[int]) -> bytes:
    """A width byte, a count of eight bytes, and each value in the least of 1, 2, 4 or 8 bytes that holds the greatest."""
    if not len(values):
        return b"\0"
    width = next(w for w in (1, 2, 4, 8) if max(values) < 1 << 8 * w)
    return struct.pack("<BQ", width, len(values)) + b"".join(v.to_bytes(width, "little") for v in values)


def unpack(data: bytes, at: int = 0) -> tuple[list[int], int]:
    if not data[at]:
        return [], at + 1
    width, n = struct.unpack_from("<BQ", data, at)
    at += 9
    return [int.from_bytes(data[at + i * width : at + (i + 1) * width], "little") for i in range(n)], at + n * width


def gaps(values: Sequence[int]) -> list[int]:
    return [b - a for a, b in zip(values, values[1:])]


def _sums(base: int, steps: Sequence[int]) -> list[int]:
    out = [base]
    for s in steps:
        out.append(out[-1] + s)
    return out


def delta(values: Sequence[int], encode=pack) -> bytes:
    """The first value as var-byte, then the gaps. An empty list is an empty string."""
    return varbyte(values[0]) + encode(gaps(values)) if len(values) else b""


def undelta(data: bytes, at: int = 0, decode=unpack) -> tuple[list[int], int]:
    if at >= len(data):
        return [], at
    base, at = read_varbyte(data, at)
    steps, at = decode(data, at)
    return _sums(base, steps), at


def _layouts(values: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(selector, from, to) of each word: the first layout that the next values fill, or that holds all the rest."""
    at = 0
    while at < len(values):
        for selector, (items, bits) in enumerate(LAYOUTS):
            part = values[at : at + items]
            if max(part) < 1 << bits:
                yield selector, at, at + len(part)
                at += len(part)
                break
        else:
            raise ValueError(f"simple9 holds no value of 2^28 or more: {values[at]}")


def simple9(values: Sequence[int]) -> bytes:
    """A var-byte count, then words of a selector in the low four bits and the items from there up."""
    out = bytearray(varbyte(len(values)))
    for selector, lo, hi in _layouts(values):
        word, bits = selector, LAYOUTS[selector][1]
        for i, v in enumerate(values[lo:hi]):
            word |= v << 4 + i * bits
        out += struct.pack("<I", word)
    return bytes(out)


def unsimple9(data: bytes, at: int = 0) -> tuple[list[int], int]:
    n, at = read_varbyte(data, at)
    out: list[int] = []
    while len(out) < n:
        (word,) = struct.unpack_from("<I", data, at)
        items, bits = LAYOUTS[word & 15]
        out += [word >> 4 + i * bits & (1 << bits) - 1 for i in range(min(items, n - len(out)))]
        at += 4
    return out, at


def simple9_words(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of many lists, values[at[i] : at[i + 1]] each, and where each list's words begin, and the end."""
    values = np.asarray(values, np.int64)
    if len(values) and int(values.max()) >= SIMPLE9_LIMIT:
        raise ValueError(f"simple9 holds no value of 2^28 or more: {int(values.max())}")
    n, end = len(values), np.repeat(at[1:], np.diff(at))
    # For each place the first layout that the values from there fill or that holds all the rest of the list.
    chosen = np.full(n, len(LAYOUTS) - 1, np.int8)
    for selector in range(len(LAYOUTS) - 2, -1, -1):
        items, bits = LAYOUTS[selector]
        wide = np.r_[0, np.cumsum(values >= 1 << bits)]
        stop = np.minimum(np.arange(n) + items, end)
        chosen[wide[stop] == wide[:-1]] = selector
    items, bits = (np.array(x) for x in zip(*LAYOUTS))
    now, of = at[:-1][np.diff(at) > 0], np.flatnonzero(np.diff(at) > 0)
    starts, owners = [], []
    while len(now):
        starts.append(now)
        owners.append(of)
        after = now + items[chosen[now]]
        go = after < at[of + 1]
        now, of = after[go], of[go]
    start = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    selector = chosen[start].astype(np.int64)
    words = selector.copy()
    stop = np.minimum(start + items[selector], end[start]) if len(start) else start
    for i in range(LAYOUTS[0][0]):
        some = np.flatnonzero(start + i < stop)
        words[some] |= values[start[some] + i] << 4 + i * bits[selector[some]]
    return words.astype("<u4"), np.searchsorted(start, at)


def encode_chunk(doc_ids: Sequence[int], freqs: Sequence[int]) -> bytes:
    return delta(doc_ids, simple9) + pack(freqs)


def decode_chunk(data: bytes) -> tuple[list[int], list[int]]:
    ids, at = undelta(data, decode=unsimple9)
    freqs, _ = unpack(data, at) if ids else ([], at)
    return ids, freqs


def _read_varbytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers at places of data; at moves behind them."""
    out, open_, shift = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(open_):
        byte = data[at[open_]].astype(np.int64)
        out[open_] |= (byte & 127) << shift
        at[open_] += 1
        open_, shift = open_[byte < 128], shift + 7
    return out


def decode_chunks(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """decode_chunk() of many chunks side by side, which end at ends: ids, frequencies, and where each chunk's begin, and the end."""
    raw = np.frombuffer(data, np.uint8)
    some = np.flatnonzero(np.diff(ends, prepend=0))
    now = np.r_[0, ends[:-1]][some].astype(np.int64)
    first, left = _read_varbytes(raw, now), _read_varbytes(raw, now)
    n = np.zeros(len(ends), np.int64)
    n[some] = left + 1
    at = np.r_[0, np.cumsum(n)]
    ids, begin = np.zeros(at[-1], np.int64), at[:-1][some]
    items, bits = (np.array(x) for x in zip(*LAYOUTS))
    place, rows = begin + 1, np.flatnonzero(left)
    while len(rows):
        word = np.zeros(len(rows), np.int64)
        for i in range(4):
            word |= raw[now[rows] + i].astype(np.int64) << 8 * i
        selector = word & 15
        take, width = np.minimum(items[selector], left[rows]), bits[selector]
        for i in range(int(take.max())):
            few = np.flatnonzero(take > i)
            ids[place[rows[few]] + i] = word[few] >> 4 + i * width[few] & (1 << width[few]) - 1
        now[rows] += 4
        place[rows] += take
        left[rows] -= take
        rows = rows[left[rows] > 0]
    ids[begin] = first
    total = np.cumsum(ids)
    ids = total - np.repeat(total[begin] - first, n[some])
    freqs, size = np.zeros(at[-1], np.int64), raw[now].astype(np.int64) if len(now) else now
    place = np.arange(at[-1]) - np.repeat(begin, n[some])
    size, start = np.repeat(size, n[some]), np.repeat(now + 9, n[some])
    for i in range(int(size.max(initial=0))):
        few = np.flatnonzero(size > i)
        freqs[few] |= raw[start[few] + place[few] * size[few] + i].astype(np.int64) << 8 * i
    return ids, freqs, at


def encode_header(ends: Sequence[int], last_doc_ids: Sequence[int], block_size: int, last_length: int) -> bytes:
    """Var-byte block size, chunk count and last chunk's length; chunk ends as gaps; var-byte last ids."""
    return varbyte(block_size) + varbyte(len(ends)) + varbyte(last_length) + delta(ends, simple9) + b"".join(map(varbyte, last_doc_ids))


def decode_header(data: bytes) -> tuple[list[int], list[int], int, int]:
    block_size, at = read_varbyte(data)
    n, at = read_varbyte(data, at)
    last_length, at = read_varbyte(data, at)
    ends, at = undelta(data, at, unsimple9) if n else ([], at)
    ids = []
    for _ in range(n):
        v, at = read_varbyte(data, at)
        ids.append(v)
    return ends, ids, block_size, last_length


def text_bytes(text: str) -> bytes:
    """A string with its length as var-byte before it."""
    data = text.encode()
    return varbyte(len(data)) + data


def read_text(data: bytes, at: int) -> tuple[str, int]:
    n, at = read_varbyte(data, at)
    return data[at : at + n].decode(), at + n


Posting = tuple[str, list[int], list[int]]


def encode_run(postings: Sequence[Posting]) -> bytes:
    """A run: var-byte count and offsets as gaps, then for each list its term, delta-coded ids and packed frequencies."""
    parts = [text_bytes(term) + delta(ids) + pack(freqs) for term, ids, freqs in postings]
    head = varbyte(len(parts)) + delta(_sums(0, [len(p) for p in parts])[:-1])
    return struct.pack("<I", len(head)) + head + b"".join(parts)


def decode_run(data: bytes) -> list[Posting]:
    (size,) = struct.unpack_from("<I", data)
    n, at = read_varbyte(data, 4)
    offsets, _ = undelta(data, at) if n else ([], at)
    out = []
    for offset in offsets:
        term, at = read_text(data, 4 + size + offset)
        ids, at = undelta(data, at)
        freqs, _ = unpack(data, at)
        out.append((term, ids, freqs))
    return out


def _varbyte_lengths(values: np.ndarray) -> np.ndarray:
    return 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 9))


def _put_varbytes(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Writes numbers at places of out; the places behind them."""
    size = _varbyte_lengths(values)
    for i in range(int(size.max(initial=0))):
        few = np.flatnonzero(size > i)
        out[at[few] + i] = values[few] >> 7 * i & 127 | np.where(size[few] == i + 1, 128, 0)
    return at + size


def _pack_widths(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of a value in each packed list of n values; 0 for an empty one."""
    some = np.flatnonzero(n)
    top = np.zeros(len(n), np.int64)
    if len(some):
        top[some] = np.maximum.reduceat(values, (np.cumsum(n) - n)[some])
    return np.where(n == 0, 0, np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, np.where(top < 1 << 32, 4, 8))))


def _put_packed(out: np.ndarray, at: np.ndarray, values: np.ndarray, n: np.ndarray, width: np.ndarray) -> np.ndarray:
    out[at] = width
    some = np.flatnonzero(n)
    for i in range(8):
        out[at[some] + 1 + i] = n[some] >> 8 * i & 255
    size = np.repeat(width, n)
    place = np.repeat(at + 9, n) + (np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)) * size
    for i in range(int(width.max(initial=0))):
        few = np.flatnonzero(size > i)
        out[place[few] + i] = values[few] >> 8 * i & 255
    return at + 1 + np.where(n > 0, 8 + n * width, 0)


def _read_packed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values and all values of packed lists; at moves behind them."""
    width, n = raw[at].astype(np.int64), np.zeros(len(at), np.int64)
    some = np.flatnonzero(width)
    for i in range(8):
        n[some] |= raw[at[some] + 1 + i].astype(np.int64) << 8 * i
    size = np.repeat(width, n)
    place = np.repeat(at + 9, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    values = np.zeros(len(size), np.int64)
    for i in range(int(width.max(initial=0))):
        few = np.flatnonzero(size > i)
        values[few] |= raw[place[few] + i].astype(np.int64) << 8 * i
    at += 1 + np.where(n > 0, 8 + n * width, 0)
    return n, values


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start[i] to start[i] + n[i], one after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def encode_run_lists(terms: pa.Array, ids: np.ndarray, freqs: np.ndarray, at: np.ndarray) -> bytes:
    """encode_run() of lists side by side: those of terms[i] are at[i] to at[i + 1]."""
    text, n = np.frombuffer(b"".join(x.encode() for x in terms.to_pylist()), np.uint8), np.diff(at)
    size = np.array([len(x.encode()) for x in terms.to_pylist()], np.int64)
    first, inner = ids[at[:-1]], np.ones(len(ids), bool)
    inner[at[:-1]] = False
    steps = np.diff(ids, prepend=0)[inner]
    wide, width = _pack_widths(steps, n - 1), _pack_widths(freqs, n)
    packed = [1 + np.where(m > 0, 8 + m * w, 0) for m, w in ((n - 1, wide), (n, width))]
    length = _varbyte_lengths(size) + size + _varbyte_lengths(first) + packed[0] + packed[1]
    start = np.cumsum(length) - length
    out = np.zeros(length.sum(), np.uint8)
    now = _put_varbytes(out, start, size)
    out[_spread(now, size)] = text
    now = _put_packed(out, _put_varbytes(out, now + size, first), steps, n - 1, wide)
    _put_packed(out, now, freqs, n, width)
    m = np.array([max(0, len(start) - 1)])
    w = _pack_widths(np.diff(start), m)
    offsets = np.zeros(int(1 + (8 + m * w)[0] if m[0] else 1), np.uint8)
    _put_packed(offsets, np.zeros(1, np.int64), np.diff(start), m, w)
    head = varbyte(len(start)) + varbyte(0) + offsets.tobytes() if len(start) else varbyte(0)
    return struct.pack("<I", len(head)) + head + out.tobytes()


def decode_run_lists(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """decode_run() of all lists side by side: terms, ids, frequencies, and where each list's begin, and the end."""
    (size,) = struct.unpack_from("<I", data)
    n, at = read_varbyte(data, 4)
    raw, now = np.frombuffer(data, np.uint8), np.zeros(0, np.int64)
    if n:
        base, at = read_varbyte(data, at)
        _, steps = _read_packed(raw, np.array([at]))
        now = 4 + size + base + np.r_[0, np.cumsum(steps)]
    length = _read_varbytes(raw, now)
    text = raw[_spread(now, length)]
    now += length
    first = _read_varbytes(raw, now)
    _, steps = _read_packed(raw, now)
    count, freqs = _read_packed(raw, now)
    at = np.r_[0, np.cumsum(count)]
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    ids = np.zeros(at[-1], np.int64)
    ids[inner], ids[at[:-1]] = steps, first
    total = np.cumsum(ids)
    ids = total - np.repeat(total[at[:-1]] - first, count)
    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())]), ids, freqs, at


LexiconEntry = tuple[str, int, int, int]


def encode_lexicon(entries: Sequence[LexiconEntry]) -> bytes:
    """Size and count in eight bytes each, then term, block offset, chunk and document frequency of each entry."""
    body = b"".join(text_bytes(t) + varbyte(block) + varbyte(chunk) + varbyte(df) for t, block, chunk, df in entries)
    return struct.pack("<QQ", len(body), len(entries)) + body


def decode_lexicon(data: bytes) -> list[LexiconEntry]:
    _, n = struct.unpack_from("<QQ", data)
    at, out = 16, []
    for _ in range(n):
        term, at = read_text(data, at)
        numbers = []
        for _ in range(3):
            v, at = read_varbyte(data, at)
            numbers.append(v)
        out.append((term, *numbers))
    return out


def plain_chunk(doc_ids: Sequence[int], freqs: Sequence[int]) -> bytes:
    """The debugging text of a chunk: ids and frequencies, a line each."""
    return (" ".join(map(str, doc_ids)) + "\n" + " ".join(map(str, freqs))).encode()


def read_plain_chunk(data: bytes) -> tuple[list[int], list[int]]:
    ids, _, freqs = data.partition(b"\n")
    return [int(x) for x in ids.split()], [int(x) for x in freqs.split()]


#: name: (encode, decode) of an ascending list of ids.
CODECS = {
    "delta_packed": (delta, lambda data: undelta(data)[0]),
    "delta_simple9": (lambda v: delta(v, simple9), lambda data: undelta(data, decode=unsimple9)[0]),
    "plain": (lambda v: " ".join(map(str, v)).encode(), lambda data: [int(x) for x in data.split()]),
}


def width(c: Column) -> Column:
    """Significant bits; 0 for 0."""
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c))).cast("long")


def varbyte_size(c: Column) -> Column:
    """A byte for each seven bits begun; ten for a negative number's 64."""
    return F.when(c < 0, 10).otherwise(sum(((c >= 1 << 7 * i).cast("int") for i in range(1, 9)), F.lit(1))).cast("long")


def varbyte_hex(c: Column) -> Column:
    """The bytes of varbyte() in hexadecimal, for any number of 63 bits."""
    n = varbyte_size(c)
    # Groups of seven bits by shifts; nine of them hold 63 bits.
    groups = F.array(*(F.shiftrightunsigned(c, 7 * i).bitwiseAND(F.lit(127)) for i in range(9)))
    byte = lambda g, i: F.lpad(F.hex(g + F.when(i == n - 1, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(F.slice(groups, F.lit(1), n.cast("int")), byte), "")


def packed_size(n: Column, greatest: Column) -> Column:
    """Bytes of pack() for n values up to greatest."""
    w = width(greatest)
    bytes_ = F.when(w <= 8, 1).when(w <= 16, 2).when(w <= 32, 4).otherwise(8)
    return F.when(n == 0, 1).otherwise(9 + n * bytes_).cast("long")


def gap_encoded(posts: DataFrame) -> DataFrame:
    """term, doc_id, tf, gap and k: the distance from the list's last id (the first id itself for the first), and the place from 1."""
    return numbered(posts).select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("prev", F.lit(0))).alias("gap"), "k")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks of gaps with what the list has before each: the ids."""
    for b in batches:
        n = b.column("list").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        gap = b.column("list").flatten().field("gap").to_numpy(zero_copy_only=False)
        owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        total = np.cumsum(gap)
        before = b.column("total").to_numpy() - b.column("sum").to_numpy()
        for lo in range(0, len(owner), FLAT):
            few = owner[lo : lo + FLAT]
            yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(few)), pa.array(total[lo : lo + FLAT] - (total[start] - gap[start] - before)[few])], ["term", "doc_id"])


def gap_decoded(encoded: DataFrame) -> DataFrame:
    """term and doc_id of rows of term, k and gap: chunks of gaps, and the sums of chunks along each list, are what is sorted."""
    chunk = encoded.withColumn("chunk_no", F.floor((F.col("k") - 1) / CHUNK).cast("long"))
    sums = gathered(chunk, "gap").withColumn("sum", F.aggregate("list", F.lit(0).cast("long"), lambda a, x: a + x["gap"]))
    held = written(sums, "gaps")
    placed = ranges.numbered(held, "chunk_no", "sum")
    out = map_arrow(placed.select("term", "list", "sum", "total"), _added, "term string, doc_id long")
    out.shared_path = [held.shared_path, placed.shared_path]
    return out


def list_sizes(posts: DataFrame) -> DataFrame:
    """term, n, and bytes of its list under var-byte gaps and under packed gaps and frequencies."""
    later = F.when(F.col("k") > 1, F.col("gap"))
    return gap_encoded(posts).groupBy("term").agg(
        F.count("*").alias("n"),
        F.sum(varbyte_size(F.col("gap"))).alias("varbyte_bytes"),
        (F.max(F.when(F.col("k") == 1, varbyte_size(F.col("gap")))) + packed_size(F.count(later), F.coalesce(F.max(later), F.lit(0)))).alias("packed_bytes"),
        packed_size(F.count("*"), F.max("tf")).alias("freq_bytes"),
    )


def gap_cost(posts: DataFrame) -> DataFrame:
    """n and the sum of log2(gap + 1): what document order is to lower."""
    return gap_encoded(posts).agg(F.count("*").alias("n"), F.round(F.sum(F.log2(F.col("gap") + 1)), 4).alias("bits"))
