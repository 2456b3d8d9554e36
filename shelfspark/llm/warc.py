"""WARC records in ZIP packages (operator 1).

Writing: one WARC record for each row, compressed by itself, in the stored member ``archive/data.warc.gz`` of a
ZIP package with ZIP64 fields; ``indexes/index.cdxj`` lists where each record is.  Of records with equal payloads
the one with the smallest page_id is the response and the others are revisits without payload.

Reading: the end of the file gives the central directory (or the ZIP64 one), the directory gives the stored
members, the indexes give the records' archives and places; records are then read by ranges, nothing is extracted.
A package may have any number of archives (``archive/``) and indexes (``indexes/*.cdx``, ``.cdxj``, also with ``.gz``);
index lines may come in any order and repeat a record. An archive that a line names but the package lacks is an error,
and so is an archive or index that isn't stored: its records can't be read by ranges.

Defined results: null html is an empty payload; a null page_id is always a response and never referred to;
rows that repeat a page_id and payload have the same role; an empty table gives no packages and no rows;
extra columns are ignored; line breaks in a URL are percent-encoded, a null URL is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded_batches, shared_dir, stored, tasks_for
from shelfspark.llm.files import Replacing, file_system

LEAST_BYTES = 0
PACKAGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A record and its payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> dict:
    """Headers of a record and what they and the block say of the payload."""
    top, _, block = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def number(name):  # records of other makers have other names and no page id
        number = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.isdigit() else None

    out = {"page_id": number(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": None, "url": head.get("WARC-Target-URI")}
    if out["record_type"] == "revisit":
        out["refers_to"] = number(head.get("WARC-Refers-To"))
        out["payload_digest"] = head["WARC-Payload-Digest"].removeprefix("sha1:")
        out["payload_bytes"] = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    else:
        out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out["payload_bytes"] = len(payload)
        said = head.get("WARC-Payload-Digest", "")
        if said.startswith("sha1:") and said != f"sha1:{out['payload_digest']}":
            raise ValueError(f"payload of page {out['page_id']} doesn't have the digest of its record")
    return out


def roles(pages: DataFrame, *, key: str = "page_id", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Revisits only: page id, payload hash, refers_to. Only ids and hashes are shuffled; a hash is aggregated before it moves."""
    narrow = pages.select(F.col(key).cast("long").alias("k"), F.sha1(F.coalesce(html, F.lit(""))).alias("h"), F.octet_length(F.coalesce(html, F.lit(""))).alias("n")).where(F.col("n") >= least_bytes)
    first = narrow.groupBy("h").agg(F.min("k").alias("refers_to"), F.count("*").alias("c")).where("c > 1").select("h", "refers_to")
    return narrow.select("k", "h").join(first, "h").where("k > refers_to").distinct()


class _Package:
    """A package being written: data first, the index at the end."""

    def __init__(self, path: str):
        self.path, self.writing = path, Replacing(path)
        self.zip = zipfile.ZipFile(self.writing.__enter__(), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page, url, payload, refers_to) -> None:
        raw, digest = record(page, url, payload, refers_to)
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = deflate.compress(raw) + deflate.flush()
        self.data.write(raw)
        self.index.append(f"{_name(page)} 20240101000000 " + json.dumps({"offset": self.size, "length": len(raw), "filename": DATA, "digest": digest}))
        self.size += len(raw)

    def close(self) -> dict:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.index).encode())
        self.zip.close()
        self.writing.__exit__(None)
        return {"path": self.path, "n_records": len(self.index), "n_bytes": self.size}


def write_packages(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages under folder; a row for each: path, n_records, n_bytes. The html is shuffled once, by page."""
    bounded_batches(pages.sparkSession)
    source = pages.select(F.col(key).cast("long").alias("k"), F.sha1(F.coalesce(html, F.lit(""))).alias("h"), F.col(url).alias("u"), F.coalesce(html, F.lit("")).alias("p"))
    rows = source.join(roles(pages, key=key, html=html, least_bytes=least_bytes), ["k", "h"], "left").select("k", "u", "p", "refers_to")
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, done, package = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for k, u, p, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or _Package(f"{folder}/pages-{part:06d}-{done:04d}.wacz")
                package.add(k, u, p.encode(), to)
                if package.size >= package_bytes:
                    yield pa.RecordBatch.from_pylist([package.close()], schema=schema)
                    package, done = None, done + 1
        if package:
            yield pa.RecordBatch.from_pylist([package.close()], schema=schema)

    return stored(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "packages")


def directory_entries(read, size: int) -> dict[str, tuple[int, int, int]]:
    """(method, offset of the local header, packed length) of each member; read(offset, length) reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # the ZIP64 locator
        (where,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        wide = read(where, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, at = struct.unpack("<QQQ", wide[32:56])
    directory, out, p = read(at, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            q += 4 + n
        p += 46 + n_name + n_extra + n_comment
        out[name] = method, header, packed
    return out


def stored_member(read, entries: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """(offset of the data, length) of a stored member."""
    method, header, length = entries[name]
    if method != 0:
        raise ValueError(f"{name} is compressed in the package, so that its records have no ranges")
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {name}")
    return header + 30 + sum(struct.unpack("<HH", local[26:30])), length


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, length) of each stored member."""
    entries = directory_entries(read, size)
    return {name: stored_member(read, entries, name) for name, (method, _, _) in entries.items() if method == 0}


def record_places(read, entries: dict[str, tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(offset in the package, length) of every record that the package's indexes list, in order of place, each once."""
    places, archives = set(), {}
    for name in entries:
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        raw = read(*stored_member(read, entries, name))
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).splitlines():
            fields = line.split(b" ", 2)
            if len(fields) < 3 or line.startswith(b"!"):  # blank lines and the index's own header
                continue
            entry = json.loads(fields[2])
            archive = entry["filename"]
            if archive not in archives:
                member = next((x for x in (archive, "archive/" + archive) if x in entries), None)
                if member is None:
                    raise ValueError(f"{name} names {archive}, which the package doesn't have")
                archives[archive] = stored_member(read, entries, member)
            (at, size), offset, length = archives[archive], int(entry["offset"]), int(entry["length"])
            if offset + length > size:
                raise ValueError(f"{name} places a record beyond the end of {archive}")
            places.add((at + offset, length))
    return sorted(places)


def locate(packages: DataFrame, *, read_bytes: int = READ_BYTES) -> DataFrame:
    """Ranges of consecutive records of each package: path, start, lengths of the records."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, own = file_system(path)
                with system.open_input_file(own) as f:
                    read = lambda at, n: f.read_at(n, at)  # noqa: B023, E731
                    places = record_places(read, directory_entries(read, f.size()))
                rows, start, lengths, held = [], None, [], 0
                for at, n in places:
                    if lengths and (held + n > read_bytes or at != start + held):
                        rows.append({"path": path, "start": start, "lengths": lengths})
                        lengths, held = [], 0
                    if not lengths:
                        start = at
                    lengths.append(n)
                    held += n
                if lengths:
                    rows.append({"path": path, "start": start, "lengths": lengths})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = packages.count()
    return packages.select("path").repartition(tasks_for(packages.sparkSession, n, n * read_bytes)).mapInArrow(run, "path string, start long, lengths array<long>")


def read_packages(packages: DataFrame, *, read_bytes: int = READ_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record."""
    ranges = stored(locate(packages, read_bytes=read_bytes), "package-ranges")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches):
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, own = file_system(path)
                with system.open_input_file(own) as f:
                    raw = f.read_at(sum(lengths), start)
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n, size = ranges.agg(F.count("*"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return ranges.repartition(tasks_for(ranges.sparkSession, n, size or 0)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes packages of all pages to the shared folder and reads them back."""
    return read_packages(write_packages(pages, shared_dir(pages.sparkSession, "warc"), **options))
