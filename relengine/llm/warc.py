"""WARC records in ZIP-packaged archives: writing with revisits, and reading by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .zipread import Member, data_at, members, read_at

DATE = "1970-01-01T00:00:00Z"  # pages carry none; a fixed one keeps archives reproducible
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = "archive/", "indexes/"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_fs(path: str):
    """The file system of a whole URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a whole URI, as Spark reads it: one without a scheme is of Hadoop's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def record(page_id: int | None, url: str | None, digest: str, n: int, refers_to: int | None, payload: bytes | None) -> bytes:
    """One WARC/1.1 record.  ``payload`` None makes a revisit, which has no payload of its own."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP % n + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Packager:
    """Writes ZIP packages of about ``most`` bytes; a package appears under its name only when whole."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.tag, self.warc = folder, most, uuid.uuid4().hex, None
        self.n = 0

    def add(self, raw: bytes, page_id) -> Iterator[tuple[str, int]]:
        if self.warc is None:
            self.warc, self.index = io.BytesIO(), []
        member = gzip.compress(raw, 6, mtime=0)
        where = {"id": page_id, "filename": posixpath.basename(ARCHIVE), "offset": str(self.warc.tell()), "length": str(len(member))}
        self.index.append(f"urn:page:{page_id} {re.sub('[^0-9]', '', DATE)} {json.dumps(where)}")
        self.warc.write(member)
        if self.warc.tell() >= self.most:
            yield self.close()

    def close(self) -> tuple[str, int]:
        fs, folder = open_fs(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"{self.tag}-{self.n:05d}.wacz"
        with fs.open_output_stream(posixpath.join(folder, f".{name}")) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for member, data in ((ARCHIVE, self.warc.getbuffer()), (INDEX, "\n".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(member), "w", force_zip64=True) as f:
                    f.write(data)
        fs.move(posixpath.join(folder, f".{name}"), posixpath.join(folder, name))
        n, self.warc, self.n = len(self.index), None, self.n + 1
        return f"{self.folder}/{name}", n


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def located(f, found: list[Member]) -> Iterator[tuple[int, int, int, int]]:
    """(where its archive begins in the package, the archive's size, offset, length) of each record that the indexes of a package list.

    Archives are the members under ARCHIVES, by their names there; indexes, which may be gzipped, those under INDEXES.
    """
    archives = {m.name.removeprefix(ARCHIVES): (data_at(f, m), m.size) for m in found if m.name.startswith(ARCHIVES) and not m.name.endswith("/")}
    for m in found:
        if not m.name.startswith(INDEXES) or m.name.endswith("/"):
            continue
        raw = read_at(f, data_at(f, m), m.size)
        for name, at, n in index_lines((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()):
            if name not in archives and len(archives) > 1 or not archives:
                raise ValueError(f"{m.name}: no archive {name}")
            yield *(archives[name] if name in archives else next(iter(archives.values()))), at, n


def index_lines(text: str) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of each line: CDXJ (key, time, JSON object), or CDX with a header of field letters."""
    letters: list[str] = []
    for line in text.splitlines():
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]  # fixed by the format: S is a record's compressed size, V its offset, g its file
        elif "{" in line:
            entry = json.loads(line[line.index("{") :])
            yield str(entry.get("filename", "")), int(entry["offset"]), int(entry["length"])
        elif line.strip() and not line.startswith("!"):
            entry = dict(zip(letters, line.split()))
            if not {"S", "V"} <= entry.keys():
                raise ValueError(f"no place in index line {line[:80]!r}")
            yield entry.get("g", ""), int(entry["V"]), int(entry["S"])


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, scratch: Scratch, package_bytes: int = 32 << 20) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to ZIP packages in ``folder``; returns the manifest (path, n_records).

    Of rows with equal payloads the one of the largest page_id is a response, the others revisit it (repeated rows
    of that page_id are all responses).  The manifest is a written table and lists each row's package once, whichever
    attempt of a task wrote it: packages that a failed attempt left are not listed.
    A null html is an empty payload; null page_id and url are kept as such; further columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("n"))
    # Digests are grouped without the pages' bytes, and only those that more than one row has are kept.  The join with them is by broadcast
    # where Spark finds them small enough; else pages are shuffled by digest, where adaptive execution splits a hot one.
    shared = p.groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    shared = scratch.table(shared, "shared")
    p = p.join(shared.withColumnsRenamed({"digest": "_d", "n": "_n"}), (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_n")), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull())
    p = p.select("page_id", "url", "digest", "n", F.when(revisit, F.col("last")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))

    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packager(folder, package_bytes)

        def done() -> Iterator[tuple[str, int]]:
            for b in batches:
                for i, url, digest, n, refers, data in zip(*(c.to_pylist() for c in b.columns[:-1]), b.columns[-1]):  # payloads one at a time
                    yield from out.add(record(i, url, base32(digest), n, refers, data.as_py()), i)
            if out.warc is not None:
                yield out.close()

        for path, n in done():
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return scratch.table(p.mapInArrow(write, "path string, n_records long"), "manifest")


def page_of(name: str | None) -> int | None:
    """The page_id in a record's name; None for a null one and for names that weren't given here."""
    m = re.fullmatch(r"<?urn:page:(-?\d+)>?", name or "")
    return int(m[1]) if m else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the packages named by ``manifest`` (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each package's end records and directory are parsed, its stored index members read, and every record that they tell of fetched by its
    range from the stored archive member of that name.  Payloads are checked against their digests.  A package that isn't whole, or
    an index line without a place, raises an error.  Records other than responses and revisits are passed over; those
    that weren't written here have no page_id.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for base, size, at, n in located(f, members(f, f.size())):
                        if at + n > size:
                            raise ValueError(f"{path}: a record ends beyond its archive")
                        fields, payload = parse(gzip.decompress(read_at(f, base + at, n)))
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        response, actual = fields["warc-type"] == "response", base32(hashlib.sha1(payload).hexdigest())
                        digest = fields.get("warc-payload-digest", "sha1:" + actual).removeprefix("sha1:")
                        if response and actual != digest:
                            raise ValueError(f"{path}: payload differs from its digest")
                        url = fields["warc-target-uri"]
                        n_bytes = int(fields.get("x-payload-length", len(payload)))
                        rows.append((page_of(fields.get("warc-record-id")), None if url.startswith("urn:page:") else url, n_bytes, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), payload if response else None))
                        if (held := held + len(payload)) > 8 << 20 or len(rows) >= 2000:
                            yield to_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP packages in the shared folder, then read back from them."""
    scratch = Scratch(spark, "warc")
    manifest = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("packages"), scratch)
    n = max(1, manifest.count())  # a package is what one task reads
    return read_archives(manifest.repartition(min(n, 4096))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: the SHA-1's bits, five at a time (20 bytes make 32 letters, no padding).
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (substr(bits, (i * 5 + 1)::INTEGER, 5)::BIT)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM (SELECT *, (unhex(digest)::BIT)::VARCHAR AS bits FROM g)
"""
