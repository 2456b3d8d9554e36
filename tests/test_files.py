import hashlib
import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import content as B
from shelfspark.operators import destinations as D
from shelfspark.operators import enrich as E
from shelfspark.operators import hashing as H
from shelfspark.operators import imports as I
from shelfspark.plans import organize as P
from shelfspark.sources import contents
from shelfspark.sources import tree as T


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def digests(data):
    return f"{zlib.crc32(data):08x}", hashlib.sha1(data).hexdigest(), hashlib.md5(data).hexdigest(), len(data)


BODY = bytes(range(256)) * 40
FILES = {
    "plain.bin": (BODY, None, BODY),
    "empty.bin": (b"", None, b""),
    "empty.smc": (b"", "smc_512", b""),
    "head.smc": (b"h" * 512 + BODY, "smc_512", BODY),
    "bare.smc": (BODY, "smc_512", BODY),
    "game.nes": (b"NES\x1a" + b"h" * 12 + BODY, "ines_16", BODY),
    "bare.nes": (BODY, "ines_16", BODY),
    "game.lnx": (b"LYNX\0" + b"h" * 59 + BODY, "lynx_64", BODY),
    "game.z64": (b"\x80\x37\x12\x40" + BODY, "n64_byteswap", b"\x80\x37\x12\x40" + BODY),
    "pairs.v64": (b"\x37\x80\x40\x12" + b"ba" * 9 + b"x", "n64_byteswap", b"\x80\x37\x12\x40" + b"ab" * 9 + b"\0x"),
    "words.n64": (b"\x40\x12\x37\x80" + b"dcba" * 5 + b"xy", "n64_byteswap", b"\x80\x37\x12\x40" + b"abcd" * 5 + b"\0\0yx"),
    "one.ZIP": (archive(a__sfc=BODY, b__txt=b"small"), None, BODY),
    "head.zip": (archive(a__smc=b"h" * 512 + BODY), "smc_512", BODY),
}


@pytest.mark.parametrize("chunk", [1, 7, 512, 4 << 20])
def test_streams_in_chunks_of_any_size(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(contents, "CHUNK", chunk)
    for name, (data, rule, bare) in FILES.items():
        (tmp_path / name).write_bytes(data)
        assert contents.digests_of(str(tmp_path / name), rule) == digests(bare), name
        assert contents.digests_of(f"file://{tmp_path}/{name}" if chunk > 1 else str(tmp_path / name), rule) == digests(bare), name


def test_streams_agree_with_column_rules(spark):
    rows = [(n, bytearray(d), r) for n, (d, r, _) in FILES.items() if not n.lower().endswith("zip")]
    df = spark.createDataFrame(rows, "name string, c binary, rule string")
    got = {r.name: bytes(r.b) for r in df.select("name", B.normalized(F.col("c"), F.col("rule")).alias("b")).collect()}
    assert got == {n: FILES[n][2] for n in got}


def test_what_cannot_be_read_is_null(tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK nonsense")
    (tmp_path / "none.zip").write_bytes(archive())
    (tmp_path / "cut.zip").write_bytes(archive(a__sfc=BODY)[:-30])
    (tmp_path / "bomb.zip").write_bytes(archive(a__sfc=b"\0" * 5000))
    for name in ("bad.zip", "none.zip", "cut.zip", "absent.bin", "absent.zip"):
        assert contents.digests_of(str(tmp_path / name), None) is None
    assert contents.digests_of(str(tmp_path / "bomb.zip"), None, limit=4999) is None
    assert contents.digests_of(str(tmp_path), None) is None


def test_file_digests_and_deal(spark, tmp_path):
    r, rows = random.Random(1), []
    for i in range(60):
        data = r.randbytes(r.choice([10, 100, 5000, 40000]))
        (tmp_path / f"f{i}").write_bytes(data)
        rows.append((i, str(tmp_path / f"f{i}"), len(data), None))
    df = spark.createDataFrame([*rows, (99, None, None, "smc_512")], "id long, path string, size_bytes long, header_rule string")
    got = {x.id: (x.crc32, x.sha1, x.md5, x.size) for x in H.file_digests(df, task_bytes=50000).collect()}
    assert got.pop(99) == (None,) * 4 and got == {i: digests((tmp_path / f"f{i}").read_bytes()) for i in range(60)}
    parts = H.dealt(df.where("path IS NOT NULL"), 50000).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("size_bytes").alias("b")).collect()
    total = sum(x[2] for x in rows)
    assert len(parts) == -(-total // 50000) and max(x.b for x in parts) <= total / len(parts) + 2 * 40000


def test_several_inside(spark, tmp_path):
    for name, data in {"two.zip": archive(a__SFC=b"1", d__nes=b"2"), "one.zip": archive(a__sfc=b"1", b__txt=b"2"), "bad.zip": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(n, str(tmp_path / n)) for n in ("two.zip", "one.zip", "bad.zip", "gone.zip", "two.bin")], "id string, path string")
    assert [r.id for r in H.several_inside(df, [".sfc", ".NES"]).collect()] == ["two.zip"]


def test_staging_in_the_library_is_refused(spark):
    none = spark.createDataFrame([], "path string")
    for staging in ("/lib", "/lib/new", "/lib/../lib/x"):
        with pytest.raises(ValueError, match="outside"):
            I.import_plan(none, none, none, none, staging_root=staging, library_root="/lib/")


def test_free_names_of_paths(spark):
    wanted = spark.createDataFrame([(1, "/l/No.1/readme"), (2, "/l/No.1/readme"), (3, "/l/a.b/c.d.sfc"), (4, "plain.bin")], "id int, name string")
    taken = spark.createDataFrame([("/l/No.1/readme_imported",), ("/l/a.b/c.d_imported_2.sfc",)], "name string")
    got = {r.id: r.free_name for r in P.unique_names(wanted, taken).collect()}
    assert got == {1: "/l/No.1/readme_imported_2", 2: "/l/No.1/readme_imported_3", 3: "/l/a.b/c.d_imported.sfc", 4: "plain_imported.bin"}


def test_landed_files(spark):
    plan = spark.createDataFrame([(1, "/l/a.sfc", "copy"), (2, "/l/a.sfc", "move"), (3, "/l/a.sfc", "keep_both"), (4, "/l/b.sfc", "skip")], "id int, target_path string, resolution string")
    none = spark.createDataFrame([], "path string")
    assert sorted((r.path, r.id, r.moved) for r in I.landed(plan, none, none).collect()) == [("/l/a.sfc", 2, True), ("/l/a_imported.sfc", 3, False)]


def test_listings_of_many_roots(spark, tmp_path):
    for p in ("a/x.png", "a/s/y.png", "a/s/t/z.png", "a/.h/h.png", "a/Logs/l.png", "b/u/v/w.png", "c/q.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    (tmp_path / "a/broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a/linked").symlink_to(tmp_path / "b")
    roots = spark.createDataFrame([(str(tmp_path / r),) for r in ("a", "a", "a/s", "b", "absent")] + [(None,)], "root string")

    def got(**options):
        return sorted((r.root[len(str(tmp_path)) + 1 :], r.rel_path, r.size_bytes) for r in T.listings(roots, **options).collect())

    every = [("a", ".h/h.png", 1), ("a", "Logs/l.png", 1), ("a", "s/t/z.png", 1), ("a", "s/y.png", 1), ("a", "x.png", 1), ("a/s", "t/z.png", 1), ("a/s", "y.png", 1), ("b", "u/v/w.png", 1)]
    for split in (0, 1, 2, 3):
        assert got(split_depth=split) == every
        assert got(split_depth=split, max_depth=2, hidden=False, skip=["logs"]) == [("a", "s/y.png", 1), ("a", "x.png", 1), ("a/s", "t/z.png", 1), ("a/s", "y.png", 1)]
    assert ("a", "broken", None) in got(unreadable=True) and len(got(unreadable=True)) == 9
    assert sorted(r.root[len(str(tmp_path)) + 1 :] for r in T.reachable(roots).collect()) == ["a", "a/s", "b"]


def test_deep_verify_hashes_bytes_as_they_are(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(archive(a__sfc=BODY))
    (tmp_path / "p.bin").write_bytes(BODY)
    destinations = spark.createDataFrame([(1, str(tmp_path), None)], "id long, target_path string, signature string")
    inventory = spark.createDataFrame([(1, "p.bin", len(BODY), 0.0, "stale", 7)], "dest_id long, rel_path string, size_bytes long, mtime double, sha1 string, rom_id long")
    now, after = D.scan_destinations(destinations, inventory, deep_verify=True)
    assert {r.rel_path: (r.sha1, r.rom_id) for r in now.collect()} == {"p.bin": (hashlib.sha1(BODY).hexdigest(), None), "z.zip": (hashlib.sha1((tmp_path / "z.zip").read_bytes()).hexdigest(), None)}
    assert after.first().signature == hashlib.sha1(b"p.bin\0z.zip").hexdigest()


def test_an_empty_destination_has_no_signature(spark, tmp_path):
    destinations = spark.createDataFrame([(1, str(tmp_path), "before")], "id long, target_path string, signature string")
    inventory = spark.createDataFrame([(1, "gone.bin", 1, 0.0, "x", 7)], "dest_id long, rel_path string, size_bytes long, mtime double, sha1 string, rom_id long")
    now, after = D.scan_destinations(destinations, inventory)
    assert now.count() == 0 and after.first().signature == ""


def test_covers_of_one_group_prefer_the_better_key(spark, tmp_path):
    for p in ("Game One.png", "img/Game One (Europe).png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    items = spark.createDataFrame([(1, f"{tmp_path}/Game One (USA).sfc", "gameone", None), (2, f"{tmp_path}/x.sfc", "", None)], "id long, path string, fuzzy_key string, dat_match string")
    none = spark.createDataFrame([], "id long, rom_id long, cover_type string, local_path string, is_preferred int")
    got = sorted((r.rom_id, r.local_path[len(str(tmp_path)) + 1 :], r.is_preferred) for r in E.discover_covers(items, none).collect())
    assert got == [(1, "Game One.png", 1), (1, "img/Game One (Europe).png", 0)]
    again = E.discover_covers(items, E.discover_covers(items, none).withColumn("cover_type", F.lit("Named_Snaps")))
    assert again.count() == 2
