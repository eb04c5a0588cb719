import base64
import hashlib
import io
import zipfile

import pytest

from relengine.llm.common import Scratch
from relengine.llm.warc import ARCHIVE, read_archives, write_archives
from relengine.llm.zipread import data_at, members, read_at


def packed(force, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, data in (("a/é.txt", b"first"), ("b.bin", bytes(range(256)) * 9), ("empty", b"")):
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=force) as f:
                f.write(data)
    return out.getvalue()


@pytest.mark.parametrize("force,comment", [(False, b""), (True, b""), (True, b"PK\x05\x06 in a comment"), (False, b"x" * 65535)])
def test_directory_and_ranges(force, comment):
    raw = packed(force, comment)
    f = io.BytesIO(raw)
    found = {m.name: read_at(f, data_at(f, m), m.size) for m in members(f, len(raw))}
    assert found == {"a/é.txt": b"first", "b.bin": bytes(range(256)) * 9, "empty": b""}


def test_zip64_end_record_with_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", b"")
    raw = out.getvalue()
    f = io.BytesIO(raw)
    assert [m.name for m in members(f, len(raw))] == [str(i) for i in range(66_000)]


def test_broken_archives_raise():
    raw = packed(False)
    for bad in (raw[:-5], b"", b"no zip at all"):
        with pytest.raises(ValueError):
            members(io.BytesIO(bad), len(bad))
    deflated = packed(False, method=zipfile.ZIP_DEFLATED)
    f = io.BytesIO(deflated)
    with pytest.raises(ValueError):
        data_at(f, members(f, len(deflated))[1])


def test_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é"), (2, "http://a/ 2\nx", "same"), (3, None, "same"), (9, "", "same"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nx\r\n\r\n"), (9, "other", "same"), (None, "n", "same"), (7, "v", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    scratch = Scratch(spark, "t")
    manifest = write_archives(spark, pages, scratch.path("packages"), scratch, package_bytes=200)
    assert manifest.count() > 3 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = read_archives(manifest).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = i == last[h or ""]
        want.append((i, len(data), digest, "response" if first else "revisit", None if first else last[h or ""]))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {i: h or "" for i, _, h in rows if i == last[h or ""]}
    assert {r.url for r in got if r.page_id == 2} == {"http://a/%202%0Ax"}
    path = manifest.first().path
    with zipfile.ZipFile(path.removeprefix("file:")) as z:  # another reader agrees
        assert z.testzip() is None and ARCHIVE in z.namelist()


def test_archives_of_others(spark, tmp_path):
    """Several archives and indexes in one package, CDX with a header and gzipped CDXJ, and records of other kinds."""
    import gzip
    import json

    from relengine.llm.warc import record

    def archive(ids):
        out, places = b"", []
        for i in ids:
            data = f"body {i}".encode()
            raw = record(i, f"http://x/{i}", base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), None, data)
            if i == 3:
                raw = raw.replace(b"urn:page:3", b"urn:uuid:3").replace(b"X-Payload-Length: 6\r\n", b"")
            if i == 4:
                raw = raw.replace(b"WARC-Type: response", b"WARC-Type: metadata")
            member = gzip.compress(raw)
            places.append((len(out), len(member)))
            out += member
        return out, places

    (one, p1), (two, p2) = archive([1, 2]), archive([3, 4])
    cdx = " CDX N b a S V g\n" + "".join(f"x/{i} 2020 http://x/{i} {n} {at} one.warc.gz\n" for i, (at, n) in enumerate(p1, 1))
    cdxj = "".join(f"x 2020 {json.dumps({'offset': at, 'length': n, 'filename': 'two.warc.gz'})}\n" for at, n in p2)
    path = tmp_path / "theirs.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in (("archive/one.warc.gz", one), ("datapackage.json", b"{}"), ("archive/two.warc.gz", two), ("indexes/a.cdx", cdx.encode()), ("indexes/b.cdxj.gz", gzip.compress(cdxj.encode()))):
            z.writestr(zipfile.ZipInfo(name), data)
    got = read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in got), key=str) == [(1, "http://x/1", b"body 1"), (2, "http://x/2", b"body 2"), (None, "http://x/3", b"body 3")]


def test_bare_paths_are_qualified(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "v", "long " * 400_000)], "page_id long, url string, html string")
    manifest = write_archives(spark, pages, str(tmp_path / "bare"), Scratch(spark, "t"))
    assert all(r.path.startswith("file:/") for r in manifest.collect())
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in read_archives(manifest).collect()) == [(1, 1, 2), (2, 1, None), (3, 2_000_000, None)]


def test_empty(spark):
    scratch = Scratch(spark, "t")
    assert read_archives(write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string"), scratch.path("p"), scratch)).count() == 0
