"""Sources, sinks and byte rules on small files, against plain Python."""

import hashlib
import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import content as B
from shelfspark.operators import enrich as E
from shelfspark.sources import registries as R
from shelfspark.sources import sinks as K
from shelfspark.sources import tree as T


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def tree(spark, tmp_path):
    for name in ["snes/Mario (USA).sfc", "snes/.hidden/x.sfc", "genesis/sub/a b/Sonic (Europe).md", "_unsorted/empty.bin", "snes/shot.png", "top.zip", "snes/backup/old.sfc"]:
        put(tmp_path / name, b"" if "empty" in name else b"12345")
    os.symlink(tmp_path / "snes", tmp_path / "link")
    spark.dataSource.register(T.TreeSource)
    return tmp_path


def test_tree_lists_every_file(spark, tree):
    rows = {r.rel_path: r for r in spark.read.format("tree").option("path", str(tree)).load().collect()}
    assert set(rows) == {"snes/Mario (USA).sfc", "snes/.hidden/x.sfc", "genesis/sub/a b/Sonic (Europe).md", "_unsorted/empty.bin", "snes/shot.png", "top.zip", "snes/backup/old.sfc"}
    assert rows["_unsorted/empty.bin"].size_bytes == 0
    assert rows["top.zip"].mtime == os.stat(tree / "top.zip").st_mtime


@pytest.mark.parametrize("split", [1, 2, 3])
def test_tree_options(spark, tree, split):
    read = spark.read.format("tree").option("path", str(tree)).option("splitDepth", split)
    got = {r.rel_path for r in read.option("maxDepth", 2).option("hidden", "false").option("skip", "Backup").load().collect()}
    assert got == {"snes/Mario (USA).sfc", "_unsorted/empty.bin", "snes/shot.png", "top.zip"}


def test_missing_tree_is_empty(spark, tree):
    assert spark.read.format("tree").option("path", str(tree / "nowhere")).load().count() == 0


def test_systems_and_accepted(spark, tree):
    systems = spark.createDataFrame([("snes", 1, ["SNES", "sfc"], [".sfc"]), ("md", 2, ["genesis", "sfc"], [".md", ".bin"]), ("x", 3, None, [".md"])], "id string, ord int, folder_aliases array<string>, extensions array<string>")
    aliases = T.alias_table(systems)
    assert {(r.alias, r.system_id) for r in aliases.collect()} == {("snes", "snes"), ("sfc", "md"), ("genesis", "md")}
    assert {r.extension for r in T.extension_table(systems).collect()} == {".sfc", ".bin"}
    found = T.resolve_systems(spark.read.format("tree").option("path", str(tree)).load(), aliases)
    by = {r.rel_path: r.system_id for r in found.collect()}
    assert by["genesis/sub/a b/Sonic (Europe).md"] == "md" and by["top.zip"] is None and by["_unsorted/empty.bin"] is None
    rows = T.library_rows(T.accepted(found, systems), str(tree)).collect()
    assert {r.filename: r.fuzzy_key for r in rows} == {"Mario (USA).sfc": "mario", "x.sfc": "x", "old.sfc": "old", "Sonic (Europe).md": "sonic"}


def test_registry(spark, tmp_path):
    put(tmp_path / "a.dat", """<?xml version="1.0"?>
<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://x/datafile.dtd">
<datafile><header><name>Maker - Console (Combined)</name></header>
<game name="Game A &amp; B (USA, Europe) (Rev 1)"><description>d</description>
<rom name="a.bin" size="1024" crc="DEADBEEF" md5="" sha1=" AAAA "/><rom name="b.bin" size="x"/><rom name=" "/></game>
<game name="Bios" isbios="yes"><rom name="c.bin" size="3"/></game><game name=""><rom name="d.bin"/></game><game name="none"/></datafile>""")
    put(tmp_path / "b.dat", "<datafile><game name='broken'><rom name='e.bin'")
    put(tmp_path / "c.dat", "")
    entries = R.registry_entries(spark, str(tmp_path))
    got = sorted(tuple(r) for r in entries.select("rom_name", "game_name", "size_bytes", "crc32", "md5", "sha1", "region", "revision", "is_bios").collect())
    name = "Game A & B (USA, Europe) (Rev 1)"
    assert got == [("a.bin", name, 1024, "deadbeef", None, "aaaa", "USA, Europe", "Rev 1", False), ("b.bin", name, None, None, None, None, "USA, Europe", "Rev 1", False), ("c.bin", "Bios", 3, None, None, None, None, None, True)]
    systems = spark.createDataFrame([("con", "Maker - Console", ["maker - console (combined)"]), ("other", None, None)], "id string, dat_name string, dat_name_aliases array<string>")
    found = R.with_systems(entries, R.registry_headers(spark, str(tmp_path)), systems)
    assert {r.system_id for r in found.collect()} == {"con"}


def test_dimension_text(spark, tmp_path):
    put(tmp_path / "x.dat", 'clrmamepro (\n\tname "X"\n)\n\ngame (\n\tcomment "A"\n\tgenre "Action"\n\trom ( crc 4019ECEC )\n)\n\ngame (\n\tcomment "B"\n\tgenre "Late"\n\trom ( crc 4019ecec )\n)\n\ngame(\n\tgenre " "\n\trom ( crc 1 )\n)\ngame (\n\tGenre "Short"\n\tROM ( CRC 12 )\n)\ngame (\n\tgenre "No crc"\n)\n')
    got = {r.crc: r.value for r in R.dimension_values(spark, str(tmp_path), "genre").collect()}
    assert got == {"4019ecec": "Action", "00000012": "Short"}


def test_dimension_table(spark, tmp_path):
    """Names of systems with blanks and signs; the first value of a crc in its file; other folders and systems are left out."""
    for folder, name, text in (("genre", "Big Co - Game + Play", 'game (\n\tgenre "One"\n\trom ( crc AB )\n)\ngame (\n\tgenre "Two"\n\trom ( crc ab )\n)\n'), ("esrb", "Big Co - Game + Play", 'game (\n\tesrb "E"\n\trom ( crc ab )\n)\n'), ("genre", "Other", 'game (\n\tgenre "No"\n\trom ( crc ab )\n)\n'), ("notes", "Big Co - Game + Play", 'game (\n\tnotes "No"\n\trom ( crc cd )\n)\n')):
        put(tmp_path / folder / f"{name}.dat", text)
    systems = spark.createDataFrame([("con", "Big Co - Game + Play")], "id string, dimension_name string")
    index = R.dimension_table(spark, str(tmp_path), systems)
    assert [(r.system_id, r.crc, r.genre, r.esrb, r.developer) for r in index.collect()] == [("con", "000000ab", "One", "E", None)]
    items = spark.createDataFrame([(1, "con", "000000ab"), (2, "other", "000000ab"), (3, "con", None)], "id int, system_id string, crc string")
    assert [(r.id, r.genre) for r in R.dimension_match(items, index).collect()] == [(1, "One")]


def test_registry_paths(spark, tmp_path):
    """Folders give .dat and .xml files at any depth, named files are taken as they are, and each file counts once."""
    for name in ("in/a b.dat", "in/deep/c.xml", "in/d.txt", "in/e.md", "f.txt"):
        put(tmp_path / name, f"<datafile><game name='{name}'><rom name='x'/></game></datafile>")
    read = lambda *paths: sorted((r.dat_file, r.game_name) for r in R.registry_entries(spark, [str(tmp_path / p) for p in paths]).collect())
    both = [("a b.dat", "in/a b.dat"), ("c.xml", "in/deep/c.xml")]
    assert read("in") == both
    assert read("in", "in/deep", "in/a b.dat", "in/d.txt", "f.txt") == sorted([*both, ("d.txt", "in/d.txt"), ("f.txt", "f.txt")])


def test_json_entries(spark, tmp_path):
    put(tmp_path / "a.json", '{"1": {"crc32": "0xAB", "title": "Élan", "release_name": "Elan (USA)"},\n "2": {"crc32": "AB", "title": "Other"}, "3": 4}')
    put(tmp_path / "b.json", "[1, 2]")
    put(tmp_path / "c.json", "not json")
    by_crc, by_title = R.json_index(R.json_entries(spark, str(tmp_path)))
    assert [(r.crc, r.title) for r in by_crc.collect()] == [("000000ab", "Élan")]
    assert {r.title_key: r.entry_key for r in by_title.collect()} == {"élan": "1", "elan": "1", "other": "2"}


def test_title_entries_last_wins(spark, tmp_path):
    put(tmp_path / "t.xml", "<LaunchBox><Game><Name>Big Game!</Name><Platform>P</Platform><Genres>one</Genres></Game><Platform><Name>P</Name></Platform><Game><Name>big game</Name><Platform>P</Platform><Genres>two</Genres></Game><Game><Name></Name></Game><Game><Name>Big Game</Name><Platform>?</Platform><Genres>loose</Genres></Game></LaunchBox>")
    platforms = spark.createDataFrame([("P", "p")], "platform string, system_id string")
    items = spark.createDataFrame([(1, "Big Game", "p"), (2, "Big: Game", "q"), (3, "none", "p"), (4, None, None)], "id int, title string, system_id string")
    got = R.title_match(items, R.title_entries(spark, str(tmp_path), platforms), ["genre"])
    assert {r.id: (r.genre, r.match_tier) for r in got.collect()} == {1: ("two", 1), 2: ("loose", 2), 3: (None, None), 4: (None, None)}


def test_texts_are_written_whole_and_inside_the_root(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.m3u", "é\n"), ("../out.m3u", "no"), ("/abs", "no"), ("b.m3u", None)], "rel_path string, content string")
    got = {r.rel_path: r.n_bytes for r in K.write_texts(rows, str(tmp_path / "r")).collect()}
    assert got == {"a/x.m3u": 3, "../out.m3u": None, "/abs": None, "b.m3u": None}
    assert [p.name for p in (tmp_path / "r").rglob("*") if p.is_file()] == ["x.m3u"]
    assert not (tmp_path / "out.m3u").exists()


def swapped(data, unit):
    data += b"\0" * (-len(data) % unit)
    return b"".join(data[i : i + unit][::-1] for i in range(0, len(data), unit))


def test_normalized_and_digests(spark):
    body = bytes(range(256)) * 5
    z64 = B.Z64 + body + b"odd"
    cases = [
        ("smc_512", b"\0" * 512 + b"\xab" * 1024, b"\xab" * 1024),
        ("smc_512", b"\xab" * 1024, b"\xab" * 1024),
        ("ines_16", b"NES\x1a" + b"\0" * 12 + body, body),
        ("ines_16", body, body),
        ("lynx_64", b"LYNX\0" + b"\0" * 59 + body, body),
        ("lynx_64", b"LYNX", b"LYNX"),
        ("n64_byteswap", swapped(z64, 2), z64 + b"\0" * (-len(z64) % 2)),
        ("n64_byteswap", swapped(z64, 4), z64 + b"\0" * (-len(z64) % 4)),
        ("n64_byteswap", B.V64 + b"xyz", swapped(B.V64 + b"xyz", 2)),
        ("n64_byteswap", z64, z64),
        ("n64_byteswap", b"", b""),
        (None, body, body),
        ("other", body, body),
        ("ines_16", None, None),
    ]
    df = spark.createDataFrame([(i, r, c) for i, (r, c, _) in enumerate(cases)], "i int, rule string, c binary")
    d = B.digests(F.col("b"))
    rows = df.withColumn("b", B.normalized(F.col("c"), F.col("rule"))).select("i", "b", *(c.alias(n) for n, c in d.items())).collect()
    for r in rows:
        want = cases[r.i][2]
        assert (bytes(r.b) if r.b is not None else None) == want
        if want is not None:
            assert (r.sha1, r.md5, r.crc32, r["size"]) == (hashlib.sha1(want).hexdigest(), hashlib.md5(want).hexdigest(), f"{zlib.crc32(want):08x}", len(want))


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    one, two = archive(**{"a.sfc": b"x" * 9}), archive(**{"dir/": b"", "a.sfc": b"x", "b.SMC": b"yy"})
    assert B.unzip(one) == b"x" * 9 and B.unzip(two) == b"yy"
    assert B.unzip(archive()) is None and B.unzip(b"PK junk") is None and B.unzip(one[:-8]) is None
    assert B.unzip(archive(a=b"\0" * 5000), limit=4999) is None and B.unzip(archive(a=b"\0" * 5000), limit=5000) is not None
    df = spark.createDataFrame([(1, one), (2, two), (3, b"junk"), (4, None)], "i int, c binary")
    got = {r.i: (r.p, r.m) for r in df.select("i", B.payload(F.col("c"), F.lit(".zip")).alias("p"), B.is_multi_archive(F.col("c"), [".sfc", ".smc"]).alias("m")).collect()}
    assert got[1] == (b"x" * 9, False) and got[2] == (b"yy", True) and got[3] == (None, False) and got[4][0] is None


def test_inner_titles(spark):
    def at(size, **slots):
        data = bytearray(b"\xff" * size)
        for o, t in slots.items():
            data[int(o[1:], 16) : int(o[1:], 16) + len(t)] = t
        return bytes(data)

    snes = at(0x8000, x7FC0=b"SUPER  GAME".ljust(21))
    z64 = B.Z64 + at(0x60)[4:0x20] + b"CARTRIDGE\0JUNK".ljust(20) + b"\0" * 8
    cases = [
        ("snes", snes, "SUPER GAME"),
        ("snes", b"\0" * 512 + snes, "SUPER GAME"),
        ("snes", at(0x10000, xFFC0=b"HIGH".ljust(21)), "HIGH"),
        ("snes", b"\0" * 100, None),
        ("n64", z64, "CARTRIDGE"),
        ("n64", swapped(z64, 2), "CARTRIDGE"),
        ("n64", b"none" + z64[4:], None),
        ("megadrive", at(0x200, x100=b"SEGA 32X       U", x150=b"A  B".ljust(48), x120=b"\x01".ljust(48)), "A B"),
        ("megadrive", at(0x200), None),
        ("gb", at(0x150, x134=b"TETRIS".ljust(16, b"\0")), "TETRIS"),
        ("nds", b"", None),
        ("nes", snes, None),
        ("gba", None, None),
    ]
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, s string, c binary")
    got = {r.i: r.t for r in df.select("i", B.inner_title(F.col("c"), F.col("s")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(cases)}


def test_localized(spark):
    cases = [('{"n": "plain"}', "plain"), ('{"n": {"text": "", "texte": "two"}}', "two"), ('{"n": [{"langue": "fr", "text": "un"}, {"region": "en", "text": "one"}]}', "one"), ('{"n": [{"langue": "fr", "text": "un"}]}', "un"), ('{"n": []}', None), ('{"n": ""}', None), ("{}", None), (None, None), ("junk", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, j string")
    got = {r.i: r.t for r in df.select("i", E.localized(F.col("j"), "$.n", ["en"]).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_spread_goes_through_other_keys(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, "c", "w"), (6, None, "z")], "id long, sha1 string, name string")
    values = spark.createDataFrame([(1, "v")], "id long, value string")
    got = {r.id: r.value for r in E.spread_to_siblings(values, items, [["sha1"], ["name"]]).collect()}
    assert got == dict.fromkeys([1, 2, 3, 4, 6], "v")
