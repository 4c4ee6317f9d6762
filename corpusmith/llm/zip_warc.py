"""WARC records in ZIP packages, read by range.

A package is a ZIP file whose members lie stored (not compressed) in it: WARC
files under archive/, each record its own gzip member, and indexes under
indexes/ (CDXJ, or CDX of 11 fields; also gzipped) that give a record's offset and
length in its WARC file. The reader takes the end record, the ZIP64 one if there,
and the central directory from a package's tail; finds where each stored member's
bytes begin; reads the indexes; and then only the records' ranges, neighbours in
one read. What no index covers is scanned record by record. Nothing is extracted.

Packages are found by a table of paths; records are spread over tasks by ranges of
TASK_BYTES of the archive, so one large package is read by many. Any file system
that pyarrow opens by URI will do.

``read_records`` has a row for every record, page or not, and one with a status
for whatever could not be read; ``records`` has the pages: response, resource and
conversion records, a response without its HTTP head and its transfer and content
encodings (chunked, gzip, deflate).

Defined results: a null path gives no row; a package that is missing, no ZIP file
or cut off is one row of status ``no package``; an index's line that can't be read
or points outside of its archive is one of status ``bad index``, and what it was
to list is scanned; a range that is no record is ``corrupt``, and reading goes on
at the next record; a record whose headers lack a type or have no number for the
length is ``bad header``; an unknown content encoding is ``undecoded``; all of
these have null texts. A record that several lines list is read once. Members that
are compressed are listed by ``members`` but not read. Records that are no page of
ours have a null page_id. A very long record is one row, held whole by its task
alone. Writing keeps null urls and pages apart from empty ones, repeated rows as
records each, and reads no other column; an empty table gives no package and no row.
"""

from __future__ import annotations

import array
import codecs
import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.shared import delete, drop_written, new_path, written
from corpusmith.functions.ship import map_arrow

#: Bytes that neighbouring records may span to be read at once; bytes of an archive that one task reads.
READ_BYTES, TASK_BYTES = 4 << 20, 8 << 20
#: Types of records that hold a page.
PAGE_KINDS = ("response", "resource", "conversion")
_TAIL = 22 + (1 << 16)
_U16, _U32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


def directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The central directory's entries; an empty list if this is no whole ZIP file. read: bytes at an offset."""
    base = max(0, size - _TAIL)
    tail = read(base, size - base)
    at = tail.rfind(b"PK\x05\x06")
    # A comment may hold the mark too: the end record is one whose comment ends the file.
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        return []
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    end = base + at
    if _U16 == count or _U32 in (length, begin):
        locator = read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            end64 = struct.unpack_from("<Q", locator, 8)[0]
            record = read(end64, 56) if end64 + 56 <= size else b""
            if record[:4] != b"PK\x06\x06":
                return []
            count, length, begin = struct.unpack_from("<QQQ", record, 32)
    if begin + length > size:
        return []
    data, out, p = read(begin, length), [], 0
    while p + 46 <= len(data) and data[p : p + 4] == b"PK\x01\x02" and len(out) < count:
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, p + 20)
        header_at = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra, e = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                # Only the fields that overflow above are here, in this order.
                field = io.BytesIO(extra[e + 4 : e + 4 + n])
                take = lambda: struct.unpack("<Q", field.read(8).ljust(8, b"\0"))[0]  # noqa: B023, E731
                full = take() if full == _U32 else full
                packed = take() if packed == _U32 else packed
                header_at = take() if header_at == _U32 else header_at
            e += 4 + n
        out.append(Member(name, method, packed, header_at))
        p += 46 + n_name + n_extra + n_comment
    return out if len(out) == count else []


def data_at(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a member's bytes begin, after its local header; -1 if there is none."""
    head = read(member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        return -1
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


class _File:
    """Ranges of a file by URI."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self._file = fs.open_input_file(path)
        self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at) if 0 <= at < self.size and n > 0 else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()


def headers_of(head: bytes) -> dict[str, str]:
    """Names in lower case; the first line is no header."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return out


def record_parts(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one WARC record; ValueError if its length is no number."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = headers_of(head)
    length = int(headers.get("content-length", len(rest)))
    if length < 0:
        raise ValueError("negative length")
    return headers, rest[:length]


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message, as far as it goes."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if n <= 0:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def http_parts(block: bytes) -> tuple[int | None, bytes, str]:
    """Status, decoded body and charset of an HTTP message; ValueError if its encoding is not known, zlib.error if broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = headers_of(head)
    line = head.partition(b"\r\n")[0].split()
    status = int(line[1]) if len(line) > 1 and line[1].isdigit() and len(line[1]) < 6 else None
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for name in reversed([x.strip() for x in headers.get("content-encoding", "").lower().split(",")]):
        if name in ("gzip", "x-gzip"):
            body = zlib.decompressobj(47).decompress(body)
        elif name == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
        elif name not in ("", "identity"):
            raise ValueError(name)
    return status, body, charset(headers.get("content-type", ""))


def charset(content_type: str) -> str:
    name = content_type.lower().partition("charset=")[2].split(";")[0].strip(" \"'")
    try:
        return codecs.lookup(name).name if name else "utf-8"
    except LookupError:
        return "utf-8"


def record(page_id: int | None, url: str | None, html: str | None, http: str | None = None) -> bytes:
    """A resource record, or with http ("", "gzip", "chunked") a response that holds the page as such a message."""
    head = ["WARC/1.1", f"WARC-Type: {'resource' if http is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head.append("Content-Type: text/html" if http is None else "Content-Type: application/http; msgtype=response")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        # A line break in a header would end it; JSON keeps any URL on one line.
        head.append(f"X-Page-Url: {json.dumps(url)}")
        if url.isprintable() and url:
            head.append(f"WARC-Target-URI: {url}")
    if html is None:
        head.append("X-Page-Null: true")
    block = (html or "").encode()
    if http is not None:
        message = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
        if http == "gzip":
            block = gzip.compress(block, 5, mtime=0)
            message.append("Content-Encoding: gzip")
        if http == "chunked":
            cut = [block[lo : lo + 4096] for lo in range(0, len(block), 4096)]
            block = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in cut) + b"0\r\n\r\n"
            message.append("Transfer-Encoding: chunked")
        block = "\r\n".join(message).encode() + b"\r\n\r\n" + block
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_package(out, rows: Iterator[tuple[int | None, str | None, str | None]], index: bool = True) -> int:
    """A package with one archive and its gzipped index, written to a stream; the number of pages. As archives are, it begins with
    a warcinfo record that no index lists, and holds resources and responses, plain, chunked and gzipped, in turn."""
    lines, n = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as archive:
            first = gzip.compress(warcinfo(), 5, mtime=0)
            archive.write(first)
            at = len(first)
            for page_id, url, html in rows:
                data = gzip.compress(record(page_id, url, html, (None, "", "gzip", "chunked")[n % 4]), 5, mtime=0)
                archive.write(data)
                lines.append(f"{url if url and url.isprintable() and ' ' not in url else '-'} 20240101000000 " + json.dumps({"filename": "data.warc.gz", "offset": str(at), "length": str(len(data))}) + "\n")
                at, n = at + len(data), n + 1
        if index:
            with z.open("indexes/index.cdx.gz", "w", force_zip64=True) as f:
                f.write(gzip.compress("".join(sorted(lines)).encode(), 5, mtime=0))
    return n


class _Write:
    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows() -> Iterator[tuple]:
            yield from zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "html")))
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    yield from zip(*(b.slice(lo, 512).column(c).to_pylist() for c in ("page_id", "url", "html")))

        # Each attempt has a file of its own; what counts is the table of paths, so a lost task's file is never read.
        path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            n = write_package(_Stream(out), rows())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n_records"])


class _Stream(io.RawIOBase):
    """An output that can't seek, as zipfile wants it."""

    def __init__(self, out):
        self._out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)


def packaged(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one package a partition of pages into folder; path and n_records of each, as a written table."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return written(map_arrow(rows, _Write(folder), "path string, n_records long"), "packages")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path in b.column("path").to_pylist():
            if path is None:
                continue
            found, size = [], 0
            try:
                with _File(path) as f:
                    size = f.size
                    found = [(path, m.name, m.method, m.size, data_at(f.read, m)) for m in directory(f.read, f.size)]
                    found = [(*x[:4], x[4] if x[4] + x[3] <= size else -1) for x in found]
            except (OSError, ValueError):  # what pyarrow raises for paths that aren't there, and for no URI
                pass
            rows += found or [(path, None, -1, size, -1)]
        columns = zip(*rows) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["path", "name", "method", "size", "data_at"])


def members(packages: DataFrame) -> DataFrame:
    """path, name, method (0: stored), size and data_at (-1: lies outside) of every member of every package. Reads directories and
    local headers only. What is no package, or an empty one, is one row without a name and of method -1."""
    return map_arrow(packages.select("path"), _members, "path string, name string, method int, size long, data_at long")


def _lines(f: _File, at: int, size: int, zipped: bool) -> Iterator[tuple[int, bytes]]:
    """The lines of an index, read piece by piece, with their places (a gzipped index's: its own); one None for a broken rest."""

    def pieces() -> Iterator[bytes]:
        d = zlib.decompressobj(31)
        for lo in range(0, size, READ_BYTES):
            data = f.read(at + lo, min(READ_BYTES, size - lo))
            while zipped and data:
                yield d.decompress(data)
                data = d.unused_data
                d = zlib.decompressobj(31) if d.eof else d
            if not zipped:
                yield data

    rest, done = b"", 0
    try:
        for piece in pieces():
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for line in lines:
                yield at if zipped else at + done, line
                done += len(line) + 1
    except zlib.error:
        yield at, None
        return
    yield at if zipped else at + done, rest


def entry(line: bytes) -> tuple[str, int, int] | None:
    """(file, offset, length) of a line of a CDXJ or CDX index; None if it has none."""
    try:
        if b"{" in line:
            x = json.loads(line[line.index(b"{") :])
            return str(x["filename"]), int(x["offset"]), int(x["length"])
        fields = line.decode().split()
        return (fields[10], int(fields[9]), int(fields[8])) if len(fields) == 11 else None
    except (ValueError, KeyError, TypeError):
        return None


def _gaps(listed: array.array, size: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of what the listed offset, length, offset, length, ... leave out."""
    spans = np.array(listed, np.int64).reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(np.r_[0, spans.sum(axis=1)])
    begins = np.r_[spans[:, 0], size]
    for k in np.flatnonzero(begins > ends):
        yield int(ends[k]), int(begins[k])


def _next_mark(f: _File, lo: int, hi: int, mark: bytes) -> int:
    """Where mark is found next from lo on; hi if nowhere."""
    while lo < hi:
        data = f.read(lo, min(READ_BYTES, hi - lo))
        if (k := data.find(mark)) >= 0:
            return lo + k
        lo += max(1, len(data) - len(mark) + 1)
    return hi


def _blank(f: _File, lo: int, hi: int) -> bool:
    return all(not f.read(x, min(READ_BYTES, hi - x)).strip(b"\0\r\n") for x in range(lo, hi, READ_BYTES))


def _gzip_length(f: _File, at: int, end: int) -> int:
    """The length of the gzip member at at; 0 if there is no whole one."""
    d, n = zlib.decompressobj(31), 0
    try:
        while not d.eof and at + n < end:
            piece = f.read(at + n, min(1 << 16, end - at - n))
            d.decompress(piece)
            n += len(piece) - len(d.unused_data)
    except zlib.error:
        return 0
    return n if d.eof else 0


def _plain_length(f: _File, at: int, end: int) -> int:
    head, want = b"", 1 << 12
    while b"\r\n\r\n" not in head and len(head) < end - at:
        head = f.read(at, min(want, end - at))
        want *= 2
    try:
        if not head.startswith(b"WARC/") or b"\r\n\r\n" not in head:
            return 0
        length = int(headers_of(head.partition(b"\r\n\r\n")[0]).get("content-length", 0))
    except ValueError:
        return 0
    return min(head.index(b"\r\n\r\n") + 4 + max(0, length) + 4, end - at)


def _scan(f: _File, at: int, size: int, zipped: bool, pos: int = 0) -> Iterator[tuple[int, int, bool]]:
    """(offset, length, whether it is a record) of what lies in an archive from pos up to size. Padding is nothing."""
    mark, measure = (b"\x1f\x8b\x08", _gzip_length) if zipped else (b"WARC/", _plain_length)
    while pos < size:
        start = _next_mark(f, at + pos, at + size, mark) - at
        n = 0
        while start < size and not (n := measure(f, at + start, at + size)):
            start = _next_mark(f, at + start + 1, at + size, mark) - at
        if start > pos and not _blank(f, at + pos, at + start):
            yield pos, start - pos, False
        if n:
            yield start, n, True
        pos = start + n if n else size


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record: path, whether it is gzipped, its offset in the package, its length, and a status if it is none."""
    for b in batches:
        for path, found in zip(b.column("path").to_pylist(), b.column("members").to_pylist()):
            archives = {m["name"]: (m["data_at"], m["size"]) for m in found if m["name"].startswith("archive/")}
            listed = {name: array.array("q") for name in archives}

            def out(at, n, zipped: bool, status: str | None) -> pa.RecordBatch:
                n = np.asarray(n, np.int64)
                return pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array(np.full(len(n), zipped)), pa.array(np.asarray(at, np.int64)), pa.array(n), pa.array([status] * len(n), pa.string())], ["path", "zipped", "at", "n", "status"])  # noqa: B023

            with _File(path) as f:
                for m in found:
                    if not (m["name"].startswith("indexes/") and m["name"].endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
                        continue
                    for at, line in _lines(f, m["data_at"], m["size"], m["name"].endswith(".gz")):
                        if line is not None and (not line.strip() or line.startswith((b" CDX", b"!meta"))):
                            continue
                        file, offset, length = (line is not None and entry(line)) or ("", -1, 0)
                        name = f"archive/{file}"
                        # Records of archives elsewhere are no fault.
                        if name in archives and 0 <= offset and 0 < length <= archives[name][1] - offset:
                            listed[name].extend((offset, length))
                        elif name in archives or offset < 0:
                            yield out([at], [len(line or b"")], False, "bad index")
                for name, (begin, size) in archives.items():
                    zipped = name.endswith(".gz")
                    spans = np.unique(np.array(listed[name], np.int64).reshape(-1, 2), axis=0)
                    # Of lines that name one place, the longest.
                    spans = spans[np.r_[spans[1:, 0] != spans[:-1, 0], True][: len(spans)]]
                    for lo in range(0, len(spans), 50_000):
                        yield out(begin + spans[lo : lo + 50_000, 0], spans[lo : lo + 50_000, 1], zipped, None)
                    for lo, hi in _gaps(listed[name], size):
                        rows = []
                        for row in _scan(f, begin, hi, zipped, lo):
                            rows.append(row)
                            if len(rows) >= 50_000:
                                yield from _found(out, rows, begin, zipped)
                                rows = []
                        yield from _found(out, rows, begin, zipped)


def _found(out, rows: list[tuple[int, int, bool]], begin: int, zipped: bool) -> Iterator[pa.RecordBatch]:
    for whole in (True, False):
        if some := [r for r in rows if r[2] == whole]:
            yield out([begin + r[0] for r in some], [r[1] for r in some], zipped, None if whole else "corrupt")


class _Read(NamedTuple):
    """What one record holds, or why it can't be told."""

    status: str
    kind: str | None = None
    page_id: int | None = None
    url: str | None = None
    http_status: int | None = None
    html: str | None = None


def read_record(data: bytes, zipped: bool) -> _Read:
    try:
        whole = gzip.decompress(data) if zipped else data
    except (zlib.error, EOFError, OSError):
        return _Read("corrupt")
    if not whole.startswith(b"WARC/"):
        return _Read("corrupt")
    try:
        headers, block = record_parts(whole)
        kind = headers["warc-type"].lower()
        page_id = int(headers["x-page-id"]) if "x-page-id" in headers else None
        url = str(json.loads(headers["x-page-url"])) if "x-page-url" in headers else headers.get("warc-target-uri")
    except (ValueError, KeyError):
        return _Read("bad header")
    if kind not in PAGE_KINDS:
        return _Read("ok", kind, page_id, url)
    http, coding = None, charset(headers.get("content-type", ""))
    if kind == "response" and (headers.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/")):
        try:
            http, block, coding = http_parts(block)
        except (ValueError, zlib.error):
            return _Read("undecoded", kind, page_id, url)
    return _Read("ok", kind, page_id, url, http, None if "x-page-null" in headers else block.decode(coding, "replace"))


_READ = "path string, at long, n long, status string, kind string, page_id long, url string, http_status int, html string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by path and offset: the records, neighbours read at once."""
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
    for b in batches:
        path, zipped, at, n = (b.column(c) for c in ("path", "zipped", "at", "n"))
        paths, zipped, at, n = path.to_pylist(), zipped.to_pylist(), at.to_numpy(), n.to_numpy()
        lo = 0
        while lo < len(paths):
            hi = lo + 1
            while hi < len(paths) and paths[hi] == paths[lo] and at[hi] + n[hi] - at[lo] <= READ_BYTES and at[hi] - at[hi - 1] - n[hi - 1] < 1 << 16:
                hi += 1
            with _File(paths[lo]) as f:
                data = f.read(int(at[lo]), int(at[hi - 1] + n[hi - 1] - at[lo]))
            rows = [read_record(data[at[k] - at[lo] : at[k] - at[lo] + n[k]], zipped[k]) for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([path.slice(lo, hi - lo), pa.array(at[lo:hi]), pa.array(n[lo:hi]), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [x.split()[0] for x in _READ.split(", ")])
            lo = hi


def read_records(packages: DataFrame) -> DataFrame:
    """path, at, n, status (ok, or what is wrong), kind, page_id, url, http_status and html of all that the packages' stored archives
    hold. Where the records lie is a written table, which drop_written of the result drops."""
    every = members(packages)
    stored = every.where("method = 0 and data_at >= 0 and (name like 'archive/%' or name like 'indexes/%')")
    per = stored.groupBy("path").agg(F.collect_list(F.struct("name", "size", "data_at")).alias("members"))
    located = written(map_arrow(per, _located, "path string, zipped boolean, at long, n long, status string"), "located")
    # AQE would put the rows, which are few bytes each, in one task; what they point to is what counts.
    parts = max(1, -(-(located.agg(F.sum("n")).first()[0] or 0) // TASK_BYTES))
    spread = located.where("status is null").withColumn("part", F.floor(F.col("at") / TASK_BYTES)).repartition(parts, "path", "part").sortWithinPartitions("path", "at")
    read = map_arrow(spread.select("path", "zipped", "at", "n"), _records, _READ)
    none = F.lit(None)
    rest = located.where("status is not null").select("path", "at", "n", "status").unionByName(every.where("method < 0").select("path", F.lit(0).cast("long").alias("at"), F.col("size").alias("n"), F.lit("no package").alias("status")))
    out = read.unionByName(rest.select("*", none.cast("string").alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("int").alias("http_status"), none.cast("string").alias("html")))
    out.shared_path = located.shared_path
    return out


def records(packages: DataFrame) -> DataFrame:
    """page_id, url and html of every page of the packages' stored archives."""
    found = read_records(packages)
    out = found.where(F.col("status") == "ok").where(F.col("kind").isin(*PAGE_KINDS)).select("page_id", "url", "html")
    out.shared_path = found.shared_path
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages as read back from packages of them in the shared folder."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "packages")
    packages = packaged(pages, folder)
    found = records(packages)
    out = written(found, "records")
    drop_written(packages, found)
    delete(spark, folder)
    return out


RECORDS_SQL = "select page_id, url, html from pages"
