"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP archive with a WARC member (records compressed one by one), a sorted index of the
records and a description, all *stored*: the place of a record in the package is a sum, so nothing is
ever extracted.  A reader asks a package for its tail, walks the central directory (ZIP64 records and
fields included) to the members, streams the index to the places of the records, and then any task
reads any record by its range.  A package without an index has its WARC member walked once instead.

Equal payloads are kept once: the row with the smallest page_id is the ``response``, every other one a
``revisit`` that refers to it and holds HTTP headers only.  Which rows those are comes from a table
of digests; payloads that have no copy never move, and digests of many rows are not a join's hot key.

Packages go to the shared folder through ``pyarrow.fs`` (local, S3, GCS, HDFS).  A task names its files
by its attempt, and only files listed in the written table count, so a task that is run again leaves at
worst an unlisted file.

Defined results: null html counts as the empty payload (which is a payload like any other); null page_ids
come last when the response is chosen and are read back as null, as are null urls; of rows equal in all
three columns one is the response.  An empty table gives no packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, key_filter, may_hold, saved, scratch

#: A package ends when it holds so many bytes or records, whichever comes first.  The second bounds its index.
PACKAGE_BYTES, PACKAGE_RECORDS = 64 << 20, 100_000
#: A range read fetches at least so much: neighbours of a record are mostly wanted too.
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
# Fixed values of the ZIP format: signatures, the marks of values that are in a ZIP64 field, that field's id.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MORE16, _MORE32, _ZIP64 = 0xFFFF, 0xFFFFFFFF, 0x0001

LOCATOR = "path string, at long, length long"
RECORD = f"{LOCATOR}, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# ---- writing


def _sort_key(url: str) -> str:
    """The url with its host's labels turned round, so that an index keeps a site together."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url
    return ",".join(reversed(host)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(kind: str, name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record with its HTTP block.  ``size`` is the whole payload's, also where none is held."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Sink:
    """A stream that only goes forward, as object stores offer it."""

    def __init__(self, stream):
        self.stream, self.size = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class Package:
    """One package being written: the WARC member first, index and description when it is closed."""

    def __init__(self, stream):
        self.sink = _Sink(stream)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.index: list[tuple[str, str]] = []
        self.place = 0

    def add(self, url: str | None, digest: str, kind: str, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        about = {"url": url, "digest": f"sha1:{digest}", "mime": "text/html" if kind == "response" else "warc/revisit", "offset": self.place, "length": len(packed), "filename": "data.warc.gz"}
        self.index.append((_sort_key(url or ""), json.dumps(about)))
        self.place += len(packed)

    def close(self) -> None:
        self.member.close()
        stamp = re.sub(r"\D", "", DATE)
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdx"), "w") as out:
            for key, about in sorted(self.index):
                out.write(f"{quote(key, safe=''.join(map(chr, range(33, 127))))} {stamp} {about}\n".encode())
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n.split("/")[1], "path": n} for n in ("archive/data.warc.gz", "indexes/index.cdx")]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self.zip.close()
        self.sink.stream.close()


def _record_name(page_id: int | None, digest: str, number: int | None = None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + ("" if number is None else f":{number}")


def _named_page(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def _copies(light: DataFrame) -> DataFrame:
    """Digests of several rows: (digest, n, first: page_id, url and row of the response)."""
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"), F.col("row").alias("row"))
    return saved(light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1"), "warc-copies")


def _with_copies(rows: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined to ``copies`` by digest.  A digest of more than one row in 512 has its line broadcast,
    of which there are at most 512; the others are joined by a shuffle that none of them can overload."""
    hot = copies.where(F.col("n") * 512 > total).select("digest", F.struct("n", "first").alias("hot"))
    rest = copies.where(F.col("n") * 512 <= total).select("digest", F.struct("n", "first").alias("copy"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    met = rows.where("hot is null").drop("hot").join(rest.hint("shuffle_merge"), "digest", "left")
    return rows.where("hot is not null").withColumnRenamed("hot", "copy").unionByName(met)


def pages_as_records(pages: DataFrame) -> DataFrame:
    """One row per page: kind, page_id, url, payload (null for a revisit), digest (hexadecimal), size, first (page_id
    of the response), number (null for a response)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    light = saved(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")).withColumn("row", F.monotonically_increasing_id()), "warc-digests")
    total, copies = light.count(), _copies(light)
    known = key_filter(copies, "digest", "warc-filter")
    shared = _with_copies(may_hold(light, "digest", known).where("maybe").drop("maybe"), copies, total).where("copy is not null and row <> copy.first.row")
    revisits = saved(shared.select(F.lit("revisit").alias("kind"), "page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "size", F.col("copy.first.page_id").alias("first"), F.col("row").alias("number"), F.col("copy.first.url").alias("_url")), "warc-revisits")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    #: Digests whose response has a twin in all three columns.
    twins = revisits.where(same("page_id", "first") & same("url", "_url")).select("digest").distinct().withColumn("twin", F.lit(True))
    rows = may_hold(rows, "digest", known)
    held = _with_copies(rows.where("maybe").drop("maybe"), copies, total)
    held = held.where(F.col("copy").isNull() | (same("page_id", "copy.first.page_id") & same("url", "copy.first.url"))).drop("copy")
    if not twins.isEmpty():
        held = held.join(twins, "digest", "left")
        held = held.where("twin is null").drop("twin").unionByName(held.where("twin").dropDuplicates(["digest"]).drop("twin"))
    responses = rows.where("not maybe").drop("maybe").unionByName(held)
    none = F.lit(None).cast("long")
    responses = responses.select(F.lit("response").alias("kind"), "page_id", "url", "payload", "digest", F.octet_length("payload").cast("long").alias("size"), none.alias("first"), none.alias("number"))
    return responses.unionByName(revisits.drop("_url"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and list the packages: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        task, package, path, made, listed = TaskContext.get(), None, None, 0, []

        def end():
            package.close()
            listed.append((path, len(package.index), package.sink.size))

        for batch in batches:
            for kind, page_id, url, payload, digest, size, first, number in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.wacz"
                    path, made = f"{folder}/{name}", made + 1
                    package = Package(store.open_output_stream(f"{root}/{name}"))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                revisits = _record_name(first, digest) if kind == "revisit" else None
                package.add(url, digest, kind, record(kind, _record_name(page_id, digest, number), page_id, url, payload or b"", digest, size, revisits))
                if package.place >= package_bytes or len(package.index) >= package_records:
                    end()
                    package = None
        if package is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*listed) if listed else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return saved(in_batches(pages_as_records(pages)).mapInArrow(run, "path string, records long, bytes long"), "warc-packages")


# ---- reading


class Archive:
    """A stored ZIP archive by range reads: its members and their places."""

    def __init__(self, path: str):
        store, name = _file_system(path)
        self.path, self.file = path, store.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def pieces(self, at: int, length: int) -> Iterator[bytes]:
        for start in range(at, at + length, READ_BYTES):
            yield self.read(start, min(READ_BYTES, at + length - start))

    def _directory(self) -> tuple[int, int, int]:
        """(place, length, shift): shift is what lies before the archive's own first byte."""
        tail = self.read(max(0, self.size - 22 - _MORE16), min(self.size, 22 + _MORE16))
        at = tail.rfind(_END)
        # The comment must end where the file ends; a comment may hold the signature itself.
        while at >= 0 and (len(tail) - at < 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError(f"no ZIP archive: {self.path}")
        entries, length, place = struct.unpack_from("<HII", tail, at + 10)
        end = self.size - len(tail) + at
        mark = self.read(end - 20, 20) if end >= 20 else b""
        at64 = None
        if mark[:4] == _LOCATOR:
            # Its place is off where something lies before the archive; then it is taken to end at its locator.
            stated = struct.unpack_from("<Q", mark, 8)[0]
            at64 = next((x for x in (stated, end - 20 - 56) if 0 <= x <= end - 76 and self.read(x, 4) == _END64), None)
        if at64 is not None:
            length, place = struct.unpack_from("<QQ", self.read(at64, 56), 40)
            end = at64
        elif entries == _MORE16 or _MORE32 in (length, place):
            raise ValueError(f"ZIP64 record missing: {self.path}")
        shift = end - length - place
        if shift < 0:
            raise ValueError(f"central directory outside the archive: {self.path}")
        return place + shift, length, shift

    def members(self) -> Iterator[tuple[str, int, int, int]]:
        """(name, method, place of its first byte, length) of each member, read from the central directory in pieces."""
        at, left, shift = self._directory()
        data = b""
        for piece in self.pieces(at, left):
            data += piece
            p = 0
            while len(data) - p >= 46:
                if data[p : p + 4] != _ENTRY:
                    raise ValueError(f"central directory broken: {self.path}")
                method, packed, whole = struct.unpack_from("<H8xII", data, p + 10)
                n, m, k = struct.unpack_from("<HHH", data, p + 28)
                if len(data) - p < 46 + n + m + k:
                    break
                place = struct.unpack_from("<I", data, p + 42)[0]
                name = data[p + 46 : p + 46 + n].decode("utf-8", "replace")
                packed, place = self._wide(data[p + 46 + n : p + 46 + n + m], whole, packed, place)
                p += 46 + n + m + k
                head = self.read(place + shift, 30)
                if head[:4] != _LOCAL:
                    raise ValueError(f"member {name} missing: {self.path}")
                yield name, method, place + shift + 30 + sum(struct.unpack_from("<HH", head, 26)), packed
            data = data[p:]
        if data:
            raise ValueError(f"central directory cut short: {self.path}")

    @staticmethod
    def _wide(extra: bytes, whole: int, packed: int, place: int) -> tuple[int, int]:
        """Length and place, from the ZIP64 field where the entry says so; the field holds just those, in order."""
        p = 0
        while p + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, p)
            if kind == _ZIP64:
                q = p + 4
                if whole == _MORE32:
                    q += 8
                if packed == _MORE32:
                    packed, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if place == _MORE32:
                    place = struct.unpack_from("<Q", extra, q)[0]
                break
            p += 4 + size
        return packed, place


def _lines(pieces: Iterator[bytes], packed: bool) -> Iterator[bytes]:
    rest, gz = b"", zlib.decompressobj(31)
    for piece in pieces:
        while packed and piece:
            rest += gz.decompress(piece)
            piece = gz.unused_data if gz.eof else b""
            if gz.eof:
                gz = zlib.decompressobj(31)
        *whole, rest = (rest + (b"" if packed else piece)).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walk_packed(pieces: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of a WARC whose records are compressed one by one."""
    start = at = 0
    gz = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            gz.decompress(piece)
            used = len(piece) - len(gz.unused_data)
            at += used
            if not gz.eof:
                break
            yield start, at - start
            piece, start, gz = piece[used:], at, zlib.decompressobj(31)


def _walk_plain(archive: Archive, at: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an uncompressed WARC, by their headers alone."""
    place = 0
    while place < length:
        head, size = b"", 4096
        while (cut := head.find(b"\r\n\r\n")) < 0 and len(head) < length - place:
            head, size = archive.read(at + place, min(size, length - place)), size * 2
        body = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head[: max(cut, 0)])
        if not body:
            raise ValueError(f"no WARC record at {at + place}: {archive.path}")
        whole = cut + 4 + int(body[1]) + 4
        yield place, whole
        place += whole


def locate(packages: DataFrame) -> DataFrame:
    """Places of all records of ``packages`` (path): path, at, length.  A member that is not stored can't be read by
    ranges; a package whose WARC is such is an error."""

    def places(path: str) -> Iterator[tuple[str, int, int]]:
        archive = Archive(path)
        warcs, indexes = {}, []
        for name, method, at, length in archive.members():
            if re.search(r"\.warc(\.gz)?$", name):
                if method:
                    raise ValueError(f"{name} is not stored: {path}")
                warcs[name.rsplit("/", 1)[-1]] = (at, length)
            elif re.search(r"^indexes/.*\.cdxj?(\.gz)?$", name) and not method:
                indexes.append((name, at, length))
        found = set()
        for name, at, length in indexes:
            for line in _lines(archive.pieces(at, length), name.endswith(".gz")):
                if b"{" in line:
                    about = json.loads(line[line.index(b"{") :])
                    found.add(about["filename"])
                    yield path, warcs[about["filename"]][0] + int(about["offset"]), int(about["length"])
        for name in warcs.keys() - found:
            at, length = warcs[name]
            walk = _walk_packed(archive.pieces(at, length)) if name.endswith(".gz") else _walk_plain(archive, at, length)
            for start, size in walk:
                yield path, at + start, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some = []
                for one in places(path):
                    some.append(one)
                    if len(some) == 10_000:
                        yield _batch(some, LOCATOR)
                        some = []
                if some:
                    yield _batch(some, LOCATOR)

    return packages.select("path").repartition(F.col("path")).mapInArrow(run, LOCATOR)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types)], list(names))


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def parse(data: bytes) -> tuple:
    """(type, id, page_id, url, payload size, payload digest, page_id referred to, intact, payload) of a record.

    A response's size and digest are its payload's own; a revisit, which holds none, states both.  ``intact``
    says whether lengths and digest are as stated."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, block = _headers(data)
    stated = int(head.get("content-length", 0))
    whole = block[stated:] == b"\r\n\r\n"
    http, payload = _headers(block[:stated])
    digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), int(http.get("content-length", 0))
    kind, refers = head.get("warc-type"), head.get("warc-refers-to", "").strip("<>")
    intact = whole
    if kind != "revisit":
        own = base32_sha1(payload)
        intact = whole and own == digest and len(payload) == size
        digest, size = own, len(payload)
    page = head.get("warc-page-id")
    return kind, head.get("warc-record-id", "").strip("<>"), None if page is None else int(page), head.get("warc-target-uri"), size, digest, _named_page(refers) if refers else None, intact, payload


def read_records(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``packages`` (path), each read by its range: RECORD's columns, with ``payloads`` also the payload.

    Neighbouring records go to one task in the order of their places, so a task's reads run forward."""
    schema = RECORD + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, start, data = None, 0, b""
        for batch in batches:
            rows, held = [], 0
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.path != path:
                    archive, start, data = Archive(path), 0, b""
                if not start <= at <= at + length <= start + len(data):
                    start, data = at, archive.read(at, min(max(length, READ_BYTES), archive.size - at))
                *told, payload = parse(data[at - start : at - start + length])
                rows.append((path, at, length, *told, payload) if payloads else (path, at, length, *told))
                held += len(payload) if payloads else 0
                if held > 4 * READ_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    near = locate(packages).repartition(F.col("path"), F.floor(F.col("at") / (8 * READ_BYTES))).sortWithinPartitions("path", "at")
    return near.mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write packages of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    packages = write_packages(pages, folder or scratch(pages.sparkSession, "warc"))
    return read_records(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")
