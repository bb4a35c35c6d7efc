"""WARC in ZIP packages: a writer, and a reader that works by ranges.

Each partition writes one package: a stored member of gzipped WARC records and a stored index of their places. The reader finds
the end of central directory (and its ZIP64 form), parses the central directory, locates the stored members by their local
headers and reads records by range; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, slices

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads from this size on are written once.
LEAST_PAYLOAD = 1000
#: Bytes of records that are fetched by one range.
FETCH = 4 << 20
#: Repeated payloads up to this number may be broadcast.
BROADCAST_ROWS = 200_000


def files(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


# ---- writing


def header(fields: list[tuple[str, object]]) -> bytes:
    # Control characters would end a line; they are escaped as in URLs.
    clean = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(v))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode("utf-8", "surrogatepass")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped record: a response with its payload, or a revisit that names the page whose payload it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(header(fields) + block + b"\r\n\r\n") + z.flush()


class Package:
    """Writes one ZIP package as a stream: records first, then their index."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page: int | None, raw: bytes) -> None:
        self.data.write(raw)
        self.lines.append(f"{'' if page is None else page} {self.at} {len(raw)}\n")
        self.at += len(raw)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(self.lines))
        self.zip.close()


# ---- reading


class Ranges:
    """Reads ``(offset, length)`` of an open file."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def __call__(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError(f"short read at {at}: {len(got)} of {n} bytes")
        return got


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Name to (place of the local header, stored size) of the stored members, by the central directory."""
    n = min(size, 22 + 65535)
    tail = read(size - n, n)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > n or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != n):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature may occur in a comment
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        here = size - n + at - 20
        locator = read(here, 20) if here >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, out, p = read(start, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, (packed, full), (a, b, c), local = struct.unpack_from("<H", directory, p + 10)[0], struct.unpack_from("<II", directory, p + 20), struct.unpack_from("<HHH", directory, p + 28), struct.unpack_from("<I", directory, p + 42)[0]
        name, extra = directory[p + 46 : p + 46 + a].decode("utf-8"), directory[p + 46 + a : p + 46 + a + b]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = list(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + k :]
        if method == 0:
            out[name] = (local, packed)
        p += 46 + a + b + c
    return out


def place(read, entry: tuple[int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes."""
    local, size = entry
    h = read(local, 30)
    if h[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return local + 30 + sum(struct.unpack_from("<HH", h, 26)), size


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one gzipped record."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def number(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner not in ("", "None") else None


#: Names of members that hold records and of indexes, whatever their folders.
RECORDS, INDEXES = re.compile(r"\.warc(\.gz)?$", re.I), re.compile(r"\.(cdxj?|idx)$", re.I)


def places(read, found: dict[str, tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records of each member, by the package's indexes; a member that no index names is walked."""
    out: dict[str, list[tuple[int, int]]] = {name: [] for name in found if RECORDS.search(name)}
    only = next(iter(out)) if len(out) == 1 else None
    for name in filter(INDEXES.search, found):
        for line in read(*place(read, found[name])).decode().splitlines():
            if "{" in line:  # a line of JSON fields after its key
                fields = json.loads(line[line.index("{") :])
                at, n, file = int(fields["offset"]), int(fields["length"]), fields.get("filename")
                member = next((m for m in out if file and m.rsplit("/", 1)[-1] == file.rsplit("/", 1)[-1]), only)
            else:
                (at, n), member = map(int, line.rsplit(" ", 2)[1:]), only
            if member is not None:
                out[member].append((at, n))
    for member, some in out.items():
        out[member] = sorted(some) if some else list(walked(read, *place(read, found[member])))
    return out


def walked(read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of a stretch, found by reading it through in ranges."""
    at = 0
    while at < size:
        z, n, p = zlib.decompressobj(31), 0, at
        while not z.eof and p < size:
            data = read(start + p, min(FETCH, size - p))
            z.decompress(data)
            n += len(data) - len(z.unused_data)
            p += len(data)
        if not z.eof:
            raise ValueError("a record is cut off")
        yield at, n
        at += n


def records(read, size: int) -> Iterator[tuple]:
    """(page, url, payload or None, length, digest, kind, refers_to) of every record, fetched by ranges of the index."""
    found = members(read, size)
    for member, lines in places(read, found).items():
        start, _ = place(read, found[member])
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and lines[j][0] + lines[j][1] - lines[i][0] <= FETCH:
                j += 1
            data = read(start + lines[i][0], lines[j - 1][0] + lines[j - 1][1] - lines[i][0])
            for offset, length in lines[i:j]:
                o = offset - lines[i][0]
                fields, block = parsed(data[o : o + length])
                http, _, payload = block.partition(b"\r\n\r\n")
                full = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                yield number(fields["warc-record-id"]), fields.get("warc-target-uri"), None if revisit else payload, full, digest, fields["warc-type"], number(fields["warc-refers-to"]) if revisit else None
            i = j


# ---- on tables


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as packages into ``folder``; one row a package: ``path, n``.

    Of equal payloads of at least ``LEAST_PAYLOAD`` bytes the largest page id is the response. A null page is an empty
    payload; rows that repeat a response's page id are responses as well; a null id is a revisit where its payload has an
    id elsewhere, else a response. A package is written under a name of its task's attempt, and only packages of finished
    tasks are listed, so lost executors leave no half-written or double records behind.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("_p"), F.unhex(F.sha1(payload)).alias("digest"))
    seen = rows.where(F.octet_length("_p") >= LEAST_PAYLOAD).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = cut(seen.where("n > 1 and first is not null").select("digest", "first"))
    at = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files(folder)
        ctx = TaskContext.get()
        path, n, package, out = f"{base}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz", 0, None, None
        for b in slices(batches, "_p"):
            for page, u, p, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "_p", "digest", "first"))):
                if package is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path + ".part")
                    package = Package(out)
                package.add(page, record(page, u, p.encode("utf-8", "surrogatepass"), digest.hex(), first, first is not None and first != page))
                n += 1
        if package is not None:
            package.close()
            out.close()
            system.move(path + ".part", path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return cut(at.select("page_id", "url", "_p", "digest", "first").mapInArrow(run, "path string, n long"))


def read(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record of the packages listed by :func:`write`: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = files(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with system.open_input_file(path) as f:
                    got, size = [], 0
                    fetch = Ranges(f)
                    for r in records(fetch, fetch.size):
                        got.append(r if payloads else (*r[:2], None, *r[3:]))
                        size += len(r[2] or b"")
                        if size > FETCH or len(got) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)
                            got, size = [], 0
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

    return packages.select("path").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def folder_for(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
