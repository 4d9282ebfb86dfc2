"""WARC records in ZIP packages: writing, and range-reading without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, the records
one after another, each a gzip member of its own, and ``indexes/index.cdxj``, one line
for each record with its id, type, digest, offset and length. The writer always adds the ZIP64 fields, so packages may
grow beyond 4 GiB. The reader opens the end of a file, parses the end-of-directory
records (ZIP64 first) and the central directory, checks that a member is stored, finds
its first byte behind its local header, and then seeks to single records: a package is
never read as a whole or unpacked to a disk. Packages without an index are walked
record by record: plain records by their headers, compressed ones by their gzip members.

Of records with equal payloads of at least ``least_bytes``, the one with the largest id
is written as response and the others as revisits, which hold headers only and refer
to it. Equal payloads are found by their SHA-1 over all rows, as an aggregation before
the shuffle; a payload that very many rows share is split over tasks by adaptive joins.

Files go to a folder that all executors see, over any file system pyarrow can open by
URI. A package gets its name from its task and attempt; only packages of tasks that
ended well are named to the reader, so a task that is run again does no harm.

Null payloads count as empty, and empty payloads are records like others. Rows that
repeat an id are written each; if they also share the payload they are of one type.
Rows with a null id are left out of the archives, as a record needs a name: the reader
doesn't return them. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import fresh_path
from .common import by_value, stored

by_value(__name__)

DATA, PLAIN, INDEX = "archive/data.warc.gz", "archive/data.warc", "indexes/index.cdxj"
_LOCAL, _CENTRAL, _END, _END64, _FIND64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL = 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP


class Packer:
    """Writes stored members front to back, with ZIP64 fields and data descriptors."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append({"name": name.encode(), "header": self.at, "crc": 0, "size": 0})
        name_bytes = self.members[-1]["name"]
        # sizes follow the data (flag bit 3); the ZIP64 field says that they have 8 bytes
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _FULL, _FULL, len(name_bytes), len(extra)) + name_bytes + extra)

    def write(self, data: bytes) -> int:
        """Appends to the open member; the offset inside it."""
        member = self.members[-1]
        start = member["size"]
        member["crc"] = zlib.crc32(data, member["crc"])
        member["size"] += len(data)
        self._put(data)
        return start

    def end(self) -> None:
        m = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"])
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], _FULL, _FULL, len(m["name"]), len(extra), 0, 0, 0, 0, _FULL)
                + m["name"] + extra
            )
        size, where, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", _FIND64, 0, where, 1))
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0))


def _at(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: compression method, first byte of the data, size."""
    tail_start = max(0, size - 65_557)
    tail = _at(file, tail_start, size - tail_start)
    end = tail.rfind(struct.pack("<I", _END))
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    find = tail_start + end - 20
    if find >= 0 and (locator := _at(file, find, 20))[:4] == struct.pack("<I", _FIND64):
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != struct.pack("<I", _END64):
            raise ValueError("broken ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    entries, out, at = _at(file, start, length), {}, 0
    for _ in range(n):
        if entries[at : at + 4] != struct.pack("<I", _CENTRAL):
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", entries, at + 10)
        packed, full, names, extras, comments = struct.unpack_from("<IIHHH", entries, at + 20)
        header, = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + names].decode()
        extra, k = entries[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                full = values.pop(0) if full == _FULL else full
                packed = values.pop(0) if packed == _FULL else packed
                header = values.pop(0) if header == _FULL else header
            k += 4 + width
        local = _at(file, header, 30)
        if local[:4] != struct.pack("<I", _LOCAL):
            raise ValueError(f"broken local header of {name}")
        a, b = struct.unpack_from("<HH", local, 26)
        out[name] = (method, header + 30 + a + b, packed)
        at += 46 + names + extras + comments
    return out


# --- WARC


def record(page: int, url: str, kind: str, payload: bytes, sha: str, refers: int | None) -> bytes:
    """A WARC record. The block of a revisit ends with the HTTP headers, which keep the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(raw: bytes) -> dict:
    """Fields of one record; the digest of a response is that of the bytes read."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    h = headers(top)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(headers(http).get("content-length", len(payload)))
    sha = h["warc-payload-digest"].removeprefix("sha1:")
    kind = h["warc-type"]
    if kind == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"damaged payload of {h['warc-record-id']}")
    number = lambda v: int(v.strip("<>").rpartition(":")[2])
    return {
        "page": number(h["warc-record-id"]), "url": h.get("warc-target-uri", ""), "type": kind, "bytes": length, "sha": sha,
        "refers": number(h["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def squeezed(raw: bytes) -> bytes:
    """One gzip member."""
    maker = zlib.compressobj(1, zlib.DEFLATED, 31)
    return maker.compress(raw) + maker.flush()


def walk_members(file, start: int, size: int, step: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the gzip members of an archive without an index."""
    at = 0
    while at < size:
        reader, used = zlib.decompressobj(31), 0
        while not reader.eof:
            data = _at(file, start + at + used, min(step, size - at - used))
            if not data:
                raise ValueError("an archive ends inside a record")
            reader.decompress(data)
            used += len(data) - len(reader.unused_data)
        yield at, used
        at += used


def walk(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the plain records of an archive without an index."""
    at = 0
    while at < size:
        head, step = b"", 4096
        while b"\r\n\r\n" not in head and at + len(head) < size:
            head += _at(file, start + at + len(head), min(step, size - at - len(head)))
        top = head.partition(b"\r\n\r\n")[0]
        length = len(top) + 4 + int(headers(top)["content-length"]) + 4
        yield at, length
        at += length


# --- jobs


def _open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else os.path.abspath(uri))


def _packing(folder: str, most: int):
    """Writes packages of up to ``most`` bytes; gives their names and numbers of records."""

    def run(batches):
        from pyspark import TaskContext

        files, base = _open_folder(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        part, done = 0, []
        pack = out = None
        index: list[str] = []

        def finish():
            pack.end()
            pack.begin(INDEX)
            pack.write("".join(index).encode())
            pack.end()
            pack.close()
            out.close()
            done.append((f"{folder}/{name}-{part}.wacz", len(index)))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page", "url", "payload", "sha", "refers"))):
                page, url, sha, refers = row[0].as_py(), row[1].as_py() or "", row[3].as_py(), row[4].as_py()
                payload = row[2].as_buffer().to_pybytes() if row[2].is_valid else b""
                if pack is None:
                    out = files.open_output_stream(f"{base}/{name}-{part}.wacz")
                    pack, index = Packer(out), []
                    pack.begin(DATA)
                kind = "response" if refers is None else "revisit"
                raw = squeezed(record(page, url, kind, payload, sha, refers))
                at = pack.write(raw)
                index.append(f"page:{page} 20000101000000 " + json.dumps({"type": kind, "digest": f"sha1:{sha}", "offset": at, "length": len(raw), "filename": DATA}) + "\n")
                if pack.at >= most:
                    finish()
                    pack, part = None, part + 1
        if pack is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return run


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, package_bytes: int = 64 << 20) -> DataFrame:
    """(path, records): packages with one record for each page that has an id."""
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload")
    )
    marked = rows.withColumn("hex", F.sha1("payload"))
    large = marked.where(F.octet_length("payload") >= least_bytes)
    groups = stored(large.groupBy("hex").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "equal-payloads")
    joined = marked.join(groups, "hex", "left")
    refers = F.when((F.octet_length("payload") >= least_bytes) & (F.col("first") != F.col("page")), F.col("first"))
    ready = joined.select("page", "url", "payload", base32("hex").alias("sha"), refers.alias("refers"))
    folder = fresh_path(pages.sparkSession, "packages")
    _make(pages, folder)
    return stored(ready.mapInArrow(_packing(folder, package_bytes), "path string, records bigint"), "package-list")


def _make(df: DataFrame, folder: str) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)


def base32(hex_col: str):
    """Upper-case base32 of 40 hex digits, in SQL."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = f"transform(sequence(0, 7), i -> cast(conv(substring({hex_col}, 5 * i + 1, 5), 16, 10) as int))"
    four = f"transform({five}, v -> concat_ws('', transform(array(15, 10, 5, 0), k -> substring({digits}, (shiftright(v, k) & 31) + 1, 1))))"
    return F.expr(f"concat_ws('', {four})")


def _listing(batches):
    """Records of packages by their index, or by walking the archive."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, place = _open_folder(path)
            info = files.get_file_info(place)
            rows: list[tuple[int, int]] = []
            with files.open_input_file(place) as f:
                members = directory(f, info.size)
                name = DATA if DATA in members else PLAIN
                method, start, size = members[name]
                if method:
                    raise ValueError(f"{name} in {path} is not stored; only records of a stored member can be addressed")
                if INDEX in members and not members[INDEX][0]:
                    lines = _at(f, *members[INDEX][1:]).decode().splitlines()
                    rows = [(e["offset"], e["length"]) for e in (json.loads(line.split(" ", 2)[2]) for line in lines)]
                else:
                    rows = list((walk_members if name == DATA else walk)(f, start, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([start + o for o, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
                names=["path", "offset", "length"],
            )


_FIELDS = pa.schema([("page", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("sha", pa.string()), ("refers", pa.int64()), ("payload", pa.binary())])


def _ranges(batches):
    path, file, rows, held = None, None, [], 0
    for batch in batches:
        for p, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
            if p != path:
                files, place = _open_folder(p)
                path, file = p, files.open_input_file(place)
            rows.append(parse(_at(file, offset, length)))
            held += length
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits) of all records of the packages in ``path``."""
    spark = packages.sparkSession
    listed = stored(packages.select("path").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_listing, "path string, offset bigint, length bigint"), "records")
    # stretches of 1 MiB of a package go to one task each, and are read front to back; the rows are
    # small and the ranges are not, so the number of tasks follows the bytes
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // (16 << 20))
    spread = listed.repartition(tasks, "path", F.shiftright("offset", 20)).sortWithinPartitions("path", "offset")
    read = spread.mapInArrow(_ranges, "page bigint, url string, type string, bytes bigint, sha string, refers bigint, payload binary")
    return read.select(
        F.col("page").alias("page_id"), "url", F.col("type").alias("record_type"), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        F.col("refers").alias("refers_to"), "payload",
    )
