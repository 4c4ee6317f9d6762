import gzip
import io
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmith.llm import zip_warc as Z

from ..compare import assert_same, save

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/b c", "x"), (None, None, None), (3, "", "é\r\n\r\n\0"), (4, "http://x\r\n/y", ""), (5, "http://z", "w" * 300_000), (5, "http://z", "w" * 300_000), (6, None, "only text")]


def package(rows=ROWS, index=True):
    out = io.BytesIO()
    Z.write_package(out, iter(rows), index)
    return out.getvalue()


def reading(data):
    return lambda at, n: data[at : at + n] if at >= 0 else b""


def zip64(data):
    """The same package with its directory in ZIP64 form: sizes, offsets and counts overflow to the ZIP64 records."""
    count, length, begin = struct.unpack_from("<HII", data, len(data) - 22 + 10)
    central, p = b"", begin
    for _ in range(count):
        head = bytearray(data[p : p + 46])
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", head, 20)
        at = struct.unpack_from("<I", head, 42)[0]
        name = data[p + 46 : p + 46 + n_name]
        extra = struct.pack("<HHQQQ", 1, 24, full, packed, at)
        struct.pack_into("<IIHHH", head, 20, 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra), 0)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        central += bytes(head) + name + extra
        p += 46 + n_name + n_extra + n_comment
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(central), begin)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return data[:begin] + central + record + locator + end


@pytest.mark.parametrize("form", [lambda d: d, zip64, lambda d: d[:-2] + struct.pack("<H", 6) + b"PK\x05\x06zz"])
def test_directory(form):
    original = package()
    data = form(original)
    found = Z.directory(reading(data), len(data))
    assert [m.name for m in found] == ["archive/data.warc.gz", "indexes/index.cdx.gz"] and {m.method for m in found} == {0}
    with zipfile.ZipFile(io.BytesIO(original)) as z:
        for m in found:
            at = Z.data_at(reading(data), m)
            assert data[at : at + m.size] == z.read(m.name)


def test_no_package():
    data = package()
    for bad in (b"", b"PK", data[:-30], data[100:-22], b"x" * 70000, b"PK\x05\x06" + b"\xff" * 18):
        assert Z.directory(reading(bad), len(bad)) == []


def frame(spark, tmp_path, *packages):
    rows = []
    for k, data in enumerate(packages):
        (tmp_path / f"p{k}.wacz").write_bytes(data)
        rows.append((f"file://{tmp_path}/p{k}.wacz",))
    return spark.createDataFrame(rows, "path string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("index", [True, False])
def test_records(spark, tmp_path, index):
    packages = frame(spark, tmp_path, package(index=index), b"no zip", zip64(package([(9, "u", "v")], index)))
    packages = packages.unionByName(spark.createDataFrame([(None,)], "path string"))
    assert rows_of(Z.records(packages)) == sorted([*ROWS, (9, "u", "v")], key=repr)


def test_plain_archives_and_compressed_members(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/plain.warc", b"".join(Z.record(*r) for r in ROWS))
        z.writestr("archive/other.warc.gz", b"never read", zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", b"{}")
    packages = frame(spark, tmp_path, out.getvalue())
    assert rows_of(Z.records(packages)) == sorted(ROWS, key=repr)
    assert {(r.name, r.method) for r in Z.members(packages).collect()} == {("archive/plain.warc", 0), ("archive/other.warc.gz", 8), ("pages/pages.jsonl", 0)}


def test_only_ranges_are_read(monkeypatch):
    data = package([(i, "u", "w" * 5000) for i in range(50)])
    seen = []
    read = lambda at, n: seen.append(n) or data[at : at + n]
    found = Z.directory(read, len(data))
    for m in found:
        Z.data_at(read, m)
    assert seen.count(30) == 2 and len(seen) == 4


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    save(spark, tmp_path, pages=pages)
    assert_same(Z.round_trip(pages), tmp_path, Z.RECORDS_SQL)
    clash = pages.withColumns({c: F.lit("clash") for c in ("path", "at", "n", "zipped", "part", "name", "members")})
    assert rows_of(Z.round_trip(clash)) == sorted(ROWS, key=repr)
    assert Z.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("listed", [[0], [1, 2], [6], [5, 0, 3], [*range(7)]])
@pytest.mark.parametrize("zipped", [True, False])
def test_records_that_an_index_leaves_out_are_read(spark, tmp_path, listed, zipped):
    import gzip
    import json

    parts = [Z.record(*r) for r in ROWS]
    parts = [gzip.compress(p) for p in parts] if zipped else parts
    name = "data.warc.gz" if zipped else "data.warc"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(f"archive/{name}", b"".join(parts))
        # Of plain records the index gives the length without the line ends after them.
        lines = [json.dumps({"filename": name, "offset": str(sum(map(len, parts[:k]))), "length": str(len(parts[k]) - (0 if zipped else 4))}) for k in listed]
        z.writestr("indexes/index.cdxj", "".join(f"- 20240101000000 {x}\n" for x in lines))
    got = Z.records(frame(spark, tmp_path, out.getvalue()))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(ROWS, PAGES).collect()))


def zipped_package(archive, indexes=(), name="data.warc.gz"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(f"archive/{name}", archive)
        for n, data in indexes:
            z.writestr(f"indexes/{n}", data)
    return out.getvalue()


def statuses(df):
    return Counter((r.status, r.kind) for r in df.collect())


def warc(kind, block, content_type="text/html", extra=()):
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://h/{kind}\r\nContent-Type: {content_type}\r\nContent-Length: {len(block)}", *extra]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_types_heads_and_encodings(spark, tmp_path):
    http = "application/http; msgtype=response"
    body = "Grüße & more".encode("latin-1")
    messages = [
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body,
        b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nabcd\r\n2\r\nef\r\n0\r\n\r\n",
        b"HTTP/1.0 200 OK\r\ncontent-encoding: GZIP\r\n\r\n" + gzip.compress(b"zipped"),
        b"HTTP/1.0 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(b"deflated"),
        b"HTTP/1.0 200 OK\r\nContent-Encoding: br\r\n\r\n???",
        b"HTTP/1.0 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip",
    ]
    parts = [warc("warcinfo", b"x: y"), *(warc("response", m, http) for m in messages), warc("request", b"GET / HTTP/1.1\r\n\r\n", http), warc("conversion", b"plain"), warc("resource", b"kept")]
    packages = frame(spark, tmp_path, zipped_package(b"".join(map(gzip.compress, parts))))
    found = Z.read_records(packages)
    assert statuses(found) == {("ok", "warcinfo"): 1, ("ok", "response"): 4, ("undecoded", "response"): 2, ("ok", "request"): 1, ("ok", "conversion"): 1, ("ok", "resource"): 1}
    assert {(r.http_status, r.html) for r in found.where("kind = 'response' and status = 'ok'").collect()} == {(200, "Grüße & more"), (404, "abcdef"), (200, "zipped"), (200, "deflated")}
    assert sorted(r.html for r in Z.records(packages).collect()) == ["Grüße & more", "abcdef", "deflated", "kept", "plain", "zipped"]


@pytest.mark.parametrize("zipped", [True, False])
def test_bad_records_are_reported_and_the_rest_read(spark, tmp_path, zipped):
    press = gzip.compress if zipped else bytes
    good = [press(warc("resource", b"p%d" % k)) for k in range(4)]
    broken = bytearray(good[1])
    if zipped:
        broken[len(broken) // 2 : -4] = b"\xff" * (len(broken) - 4 - len(broken) // 2)
    else:
        broken[:5] = b"wrong"
    bad_length = press(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: many\r\n\r\nx\r\n\r\n")
    no_type = press(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    data = b"".join([good[0], bytes(broken), good[2], bad_length, good[3], no_type]) + b"\0" * 100
    found = Z.read_records(frame(spark, tmp_path, zipped_package(data, (), "data.warc.gz" if zipped else "data.warc")))
    got = statuses(found)
    assert got[("ok", "resource")] == 3 and got[("bad header", None)] == (2 if zipped else 1) and got[("corrupt", None)] == (1 if zipped else 2) and len(got) == 3
    assert sorted(r.html for r in found.where("status = 'ok'").collect()) == ["p0", "p2", "p3"]


def test_broken_indexes_and_packages(spark, tmp_path):
    parts = [gzip.compress(warc("resource", b"p%d" % k)) for k in range(5)]
    data, at = b"".join(parts), [sum(map(len, parts[:k])) for k in range(5)]
    line = lambda k: f'k 2024 {{"filename": "data.warc.gz", "offset": "{at[k]}", "length": {len(parts[k])}}}\n'
    plain = f" CDX N b a m s k r M S V g\nu 2024 u text/html 200 d - - {len(parts[2])} {at[2]} data.warc.gz\n"
    bad = 'no json\nk 2024 {"filename": "data.warc.gz"}\nk 2024 {broken\nk 2024 {"filename": "data.warc.gz", "offset": 999999, "length": 5}\nk 2024 {"filename": "elsewhere.warc.gz", "offset": 1, "length": 5}\n\n'
    indexes = [("a.cdxj", line(0) + bad + line(0)), ("b.cdx", plain), ("c.cdxj.gz", gzip.compress(line(1).encode()) + gzip.compress(line(0).encode())), ("d.cdx.gz", b"no gzip")]
    packages = frame(spark, tmp_path, zipped_package(data, indexes), b"no zip")
    packages = packages.unionByName(spark.createDataFrame([(f"file://{tmp_path}/missing.wacz",), (None,), ("no uri",)], "path string"))
    found = Z.read_records(packages)
    assert statuses(found) == {("ok", "resource"): 5, ("bad index", None): 5, ("no package", None): 3}
    assert sorted(r.html for r in Z.records(packages).collect()) == [f"p{k}" for k in range(5)]


def test_an_index_that_points_between_records(spark, tmp_path):
    parts = [gzip.compress(warc("resource", b"p%d" % k)) for k in range(3)]
    index = '- 2024 {"filename": "data.warc.gz", "offset": 3, "length": 20}\n'
    found = Z.read_records(frame(spark, tmp_path, zipped_package(b"".join(parts), [("a.cdxj", index)])))
    got = statuses(found)
    assert got[("ok", "resource")] == 2 and got[("corrupt", None)] == len(found.collect()) - 2


def test_reading_is_spread_by_bytes(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(Z, "TASK_BYTES", 1 << 16)
    rows = [(k, f"http://h/{k}", os.urandom(6000).hex()) for k in range(200)]
    data = package(rows)
    read = Z.records(frame(spark, tmp_path, data))
    assert read.rdd.getNumPartitions() >= len(data) // (1 << 16)
    assert rows_of(read) == sorted(rows, key=repr)
