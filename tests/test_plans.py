"""Saved plans, detail rules and destination folders on small inputs."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import enrich as E
from shelfspark.plans import saved as S


def test_plans_are_saved_and_read(spark, tmp_path):
    root = str(tmp_path / "plans")
    actions = spark.createDataFrame([("copy", 1, None), ("copy", 2, "x"), ("delete", None, "é\n")], "kind string, rom_id long, reason string")
    S.save(actions, root, 1, 5, "push_merge")
    S.save(actions.limit(0), root, 2, 5, "pull")
    S.set_status(spark, root, 1, "applied")
    S.set_status(spark, root, 9, "applied")
    got = {r.plan_id: (r.dest_id, r.mode, r.status, r.summary) for r in S.saved_plans(spark, root).collect()}
    assert got == {1: (5, "push_merge", "applied", '{"copy":2,"delete":1}'), 2: (5, "pull", "pending", "{}")}
    assert sorted(map(tuple, S.load(spark, root, 1, actions.schema).collect()), key=str) == sorted(map(tuple, actions.collect()), key=str)
    assert S.load(spark, root, 2, actions.schema).count() == 0
    S.save(actions.withColumn("game_id", F.lit(None).cast("long")), root, 3, 5, "pull")
    with pytest.raises(ValueError):
        S.load(spark, root, 3, actions.schema)


def test_approvals_and_bulk_resolution(spark):
    plan = spark.createDataFrame([(1, "dupe_filename", "skip"), (2, "dupe_content", "skip"), (3, "new", "copy")], "id long, status string, resolution string")
    assert {r.id: r.resolution for r in S.resolve_all(plan, "replace").collect()} == {1: "replace", 2: "skip", 3: "copy"}
    assert [r.id for r in S.approved(plan, plan.where("id = 2").union(plan.where("id = 2")), ["id"]).collect()] == [2]


def test_destination_systems(spark):
    files = spark.createDataFrame([("Roms/share/SNES/a b.sfc",), ("roms/snes/x.sfc",), ("top.zip",), ("snes",), ("",), (None,), ("roms/md/sub/y.md",)], "rel_path string")
    mappings = spark.createDataFrame([("snes", "snes"), ("satellaview", "SNES"), ("none", ""), ("md", "MD")], "system_id string, folder string")
    got = {r.rel_path: (r.system_id, r.landing_path) for r in E.destination_systems(files, mappings, "/roms/share").collect()}
    assert got["Roms/share/SNES/a b.sfc"] == ("satellaview", "satellaview/a b.sfc") and got["roms/snes/x.sfc"] == ("satellaview", "satellaview/x.sfc")
    assert got["top.zip"] == (None, "_unsorted/top.zip") and got["roms/md/sub/y.md"] == ("md", "md/y.md") and got[""][0] is None and got[None][0] is None


def test_details_and_small_rules(spark):
    items = spark.createDataFrame([(1, "f.sfc", "T", "", "D", "dat_verified", 0), (2, "g.sfc", "", None, "D", "fuzzy", 2048), (3, None, None, "C", None, "dat_verified", None)], "id long, filename string, title string, canonical_name string, dat_match string, match_confidence string, size_bytes long")
    metadata = spark.createDataFrame([(1, "", 1990)], "rom_id long, release_date string, release_year int")
    hashes = spark.createDataFrame([(2, "a" * 40), (1, None)], "rom_id long, sha1 string")
    fav = spark.createDataFrame([(3,), (3,)], "rom_id long")
    got = {r.id: tuple(r)[1:] for r in E.details(items, metadata, hashes, fav).collect()}
    assert got == {1: ("T", "D", "1990", None, None, False), 2: ("g.sfc", None, None, "aaaaaaaa…aaaa", "2.0 KB", False), 3: ("C", "C", None, None, None, True)}
    same = spark.createDataFrame([(None, "a"), ("", "a"), ("a", "a"), ("b", "a"), ("b", None)], "p string, c string").select(E.signature_matches(F.col("p"), F.col("c")).alias("m")).collect()
    assert [r.m for r in same] == [True, True, True, False, False]
    assert tuple(E.file_totals(items.limit(0)).first()) == (0, 0, 0)
