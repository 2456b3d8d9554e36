import base64
import hashlib
import gzip
import io
import json
import zipfile

import pytest

from shelfspark.llm import warc


def brute(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        to = first.get(h or "") if i is not None and len(b) >= least and first[h or ""] < i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_cases(spark):
    rows = [(5, "<p>é"), (3, "<p>é"), (7, None), (9, ""), (None, "<p>é"), (11, "x" * 300_000), (12, "x" * 300_000), (3, "<p>é"), (9, ""), (20, "one\r\n\r\ntwo")]
    df = spark.createDataFrame([(i, None if i == 7 else f"http://a/{i}\n?q=é", h, 1) for i, h in rows], "page_id long, url string, html string, record_type int")
    for options in ({}, {"package_bytes": 200, "least_bytes": 2}):
        got = warc.warc_round_trip(df, **options).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, options.get("least_bytes", 0))
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, QUERIES["op1_warc_packages"](spark, tiny).select(COLUMNS).collect()), key=str) == brute(rows)


def test_packages_are_zip_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<b>{i % 3}") for i in range(50)], "page_id long, url string, html string")
    for r in warc.write_packages(df, str(tmp_path), package_bytes=900).collect():
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and {i.filename for i in z.infolist()} == {warc.DATA, warc.INDEX} and all(i.compress_type == 0 for i in z.infolist())


def test_directories():
    """Plain and ZIP64 directories, comments, compressed members."""
    for wide in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for k in range(70_000 if wide else 3):  # more than 65,535 members need the ZIP64 directory
                z.writestr(zipfile.ZipInfo(f"m{k}"), b"data%d" % k)
            z.writestr(zipfile.ZipInfo("packed"), b"x" * 99, zipfile.ZIP_DEFLATED)
            z.comment = b"PK comment"
        data = raw.getvalue()
        got = warc.members(lambda at, n: data[at : at + n], len(data))  # noqa: B023
        assert "packed" not in got and len(got) == (70_000 if wide else 3)
        at, n = got["m2"]
        assert data[at : at + n] == b"data2"


def test_zip64_fields():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
        f.write(b"hello")
    data = bytearray(raw.getvalue())
    # the directory entry with its sizes and offset moved to a ZIP64 extra field
    p = data.rfind(b"PK\x01\x02")
    end = data.rfind(b"PK\x05\x06")
    entry = bytearray(data[p:end])
    entry[20:28] = b"\xff" * 8
    entry[42:46] = b"\xff" * 4
    extra = b"\x01\x00\x18\x00" + (5).to_bytes(8, "little") * 2 + (0).to_bytes(8, "little")
    entry[30:32] = len(extra).to_bytes(2, "little")
    entry = entry[:47] + extra
    tail = bytearray(data[end:])
    tail[12:16] = len(entry).to_bytes(4, "little")
    data = bytes(data[:p]) + bytes(entry) + bytes(tail)
    at, n = warc.members(lambda a, k: data[a : a + k], len(data))["a"]
    assert data[at : at + n] == b"hello"


def package(path, archives, indexes, packed=()):
    """archives: name to records; indexes: name to (archive, record number, filename field)."""
    places = {}
    with zipfile.ZipFile(path, "w") as z:
        for name, records in archives.items():
            raw = b""
            for k, r in enumerate(records):
                one = gzip.compress(r)
                places[name, k] = len(raw), len(one)
                raw += one
            z.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED if name in packed else zipfile.ZIP_STORED)
        for name, lines in indexes.items():
            text = "!meta {}\n" + "".join(f"com,a)/ 2024 {json.dumps({'offset': str(places[a, k][0]), 'length': places[a, k][1], 'filename': f})}\n" for a, k, f in lines)
            z.writestr(zipfile.ZipInfo(name), gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())


def test_packages_of_several_archives(spark, tmp_path):
    """Two archives, two indexes out of order, a line twice, plain and full file names, records of another maker."""
    made = [warc.record(i, f"http://a/{i}", b"page %d" % i, None)[0] for i in range(4)]
    other = made[3].replace(b"<urn:page:3>", b"<urn:uuid:ab>")
    archives = {"archive/a.warc.gz": made[:2], "archive/b.warc.gz": [made[2], other]}
    lines = [("archive/b.warc.gz", 1, "b.warc.gz"), ("archive/a.warc.gz", 1, "archive/a.warc.gz"), ("archive/b.warc.gz", 0, "b.warc.gz")]
    good = {"indexes/index.cdxj": lines, "indexes/more.cdx.gz": [("archive/a.warc.gz", 0, "a.warc.gz"), lines[1]]}
    at = str(tmp_path / "two.wacz")
    package(at, archives, good)
    for read_bytes in (1, 1 << 20):
        got = warc.read_packages(spark.createDataFrame([(at,)], "path string"), read_bytes=read_bytes).select("page_id", "payload_bytes", "url").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(0, 6, "http://a/0"), (1, 6, "http://a/1"), (2, 6, "http://a/2"), (None, 6, "http://a/3")], key=str)


def test_packages_that_cannot_be_read_by_ranges(tmp_path):
    archives, line = {"archive/a.warc.gz": [warc.record(1, None, b"x", None)[0]]}, ("archive/a.warc.gz", 0, "a.warc.gz")
    for name, packed, field, said in (("packed", ["archive/a.warc.gz"], "a.warc.gz", "compressed"), ("missing", [], "z.warc.gz", "doesn't have")):
        at = tmp_path / name
        package(at, archives, {"indexes/index.cdxj": [(*line[:2], field)]}, packed)
        data = at.read_bytes()
        read = lambda a, n: data[a : a + n]  # noqa: B023, E731
        with pytest.raises(ValueError, match=said):
            warc.record_places(read, warc.directory_entries(read, len(data)))
