"""Destinations, collections, contained titles and YAML files on small inputs, against plain Python."""

import random

from shelfspark.operators import collections as L
from shelfspark.operators.resolve import contained_pick
from shelfspark.sources import profiles as Y


def test_destination_names_fill_gaps(spark):
    saved = [(1, "Q", "/a", "p"), (2, "Q (2)", "/b", "p"), (3, "Q (4)", "/c", "p"), (4, "R (2)", "/d", "p"), (5, "Q", "/a", "x"), (6, None, None, None)]
    wanted = [("/a", "n", "Q"), ("/e", "n", "Q"), ("/f", "n", "Q"), ("/g", "n", "Q"), ("/h", "n", "R"), ("/i", "n", "R"), ("/j", "n", "S"), ("/j", "o", "T"), (None, "n", "S")]
    got = L.ensure_destinations(spark.createDataFrame(saved, "id long, name string, target_path string, profile_id string"), spark.createDataFrame(wanted, "target_path string, profile_id string, name string"))
    assert {r.target_path: (r.name, r.is_new) for r in got.collect()} == {"/a": ("Q", False), "/e": ("Q (3)", True), "/f": ("Q (5)", True), "/g": ("Q (6)", True), "/h": ("R", True), "/i": ("R (3)", True), "/j": ("S", True)}


def test_collections(spark):
    c = spark.createDataFrame([(1, "Favorites", True), (2, "b", False), (3, "c", False)], "id long, name string, is_system boolean")
    m = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "collection_id long, rom_id long")
    m = L.remove_members(L.add_members(m, m.union(spark.createDataFrame([(3, 9)], m.schema))), spark.createDataFrame([(2, 8)], m.schema))
    kept, left, refused = L.delete(c, m, spark.createDataFrame([(1,), (2,), (2,), (99,)], "id long"))
    assert sorted((r.id, r.n_members) for r in L.sizes(kept, left).collect()) == [(1, 1), (3, 1)]
    assert [r.id for r in refused.collect()] == [1]
    assert sorted(r.name for r in L.create(c, spark.createDataFrame([(9, "b", False), (10, "d", False)], c.schema)).collect()) == ["Favorites", "b", "c", "d"]


def test_contained_pick(spark):
    rng = random.Random(3)
    words = ["super", "mario", "world", "of", "the"]
    rows = [(i, rng.choice("xy"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(150)] + [(900, "z", ""), (901, "z", None), (902, "z", "é" * 12), (903, "z", "a" + "é" * 13)]
    both = lambda a, b: a == b or (len(a) >= 12 and len(b) >= 12 and (a in b or b in a))
    want = {i: min((j for j, h, u in rows if j != i and h == g and None not in (t, u) and both(t, u)), default=None) for i, g, t in rows}
    got = contained_pick(spark.createDataFrame(rows, "id long, g string, t string"), "g", "t", "id").collect()
    assert {r.id: r.pick for r in got} == want


def test_registry_files(spark, tmp_path):
    texts = {"a": "systems:\n  - {id: nes, display_name: N, short_name: N, extensions: [.NES], folder_aliases: [FC]}\n  - {id: two, display_name: T, short_name: T}\n", "b": "systems:\n  - {id: two, display_name: T, short_name: T}\n  - {id: x}\n", "c": "other: 1\n", "d": "", "e": "a: [", "f": "systems: []\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    rows = Y.registry_systems(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6], r.id or "", r.problem or "") for r in rows) == [("a", "nes", ""), ("a", "two", "repeated_id"), ("b", "two", "repeated_id"), ("b", "x", "incomplete"), ("c", "", "no_systems"), ("e", "", "not_yaml")]
    nes = next(r for r in rows if r.id == "nes")
    assert nes.extensions == [".nes"] and nes.folder_aliases == ["fc"]


def test_profiles_override(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "p.yaml").write_text("id: p\nname: First\nbase_path: roms\nsystems:\n  nes: {folder: nes, extensions: [.nes]}\n")
    (one / "q.yaml").write_text("id: q\nname: Q\nbase_path: roms\nsystems:\n  nes: {folder: nes}\n  n64: {folder: ''}\n  gb: {folder: gb, supported: false}\n")
    (one / "bad.yaml").write_text("id: r\nname: R\nbase_path: ../up\n")
    (one / "bad2.yaml").write_text("id: s\nname: S\nbase_path: roms\nsystems:\n  nes: {folder: /abs}\n")
    (two / "p.yaml").write_text("id: p\nname: Second\nbase_path: games\ncase_sensitive: false\n")
    (two / "broken.yaml").write_text("id: [")
    got = Y.profiles(spark, [str(one), str(two)])
    assert sorted((r.id, r.name, r.base_path, r.case_sensitive, r.artwork_filename_template) for r in got.collect()) == [("p", "Second", "games", False, "{stem}{ext}"), ("q", "Q", "roms", True, "{stem}{ext}")]
    assert sorted((r.system_id, r.folder, r.supported) for r in Y.mappings(got).collect()) == [("gb", "gb", False), ("n64", "", False), ("nes", "nes", True)]
