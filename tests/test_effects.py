"""Effects, lookups and names on small inputs: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators import effects as E
from shelfspark.operators import lookups as U
from shelfspark.plans import organize as P


def test_safe_paths(spark):
    good = ["roms", "nes/common", "a//b", "a/b..c", "content/con2", "x/com10"]
    bad = ["", "/etc", "\\\\server", "nes\\common", "ab:c", "C:x", "a/../b", "..", "con/x", "x/NUL", "x/lpt1.txt", "aux. ", "a\x01b", "a\x00"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "p string").select("p", N.valid_relative_path(F.col("p")).alias("ok"), N.valid_relative_path(F.col("p"), allow_empty=True).alias("empty_ok"))
    got = {r.p: (r.ok, r.empty_ok) for r in df.collect()}
    assert [p for p in got if got[p][0]] == good and got[""] == (False, True)


def test_names_with_wide_blanks(spark):
    one = spark.createDataFrame([("Final Fantasy II (USA)",)], "n string").select(N.clean_name(F.col("n")).alias("c"), N.fuzzy_key(N.clean_name(F.col("n"))).alias("k")).first()
    assert tuple(one) == ("Final Fantasy II", "finalfantasy2")


def test_free_names(spark):
    wanted = spark.createDataFrame([(1, "a.sfc"), (2, "a.sfc"), (3, "b"), (4, "a.SFC")], "id long, name string")
    taken = spark.createDataFrame([("a.sfc",), ("a_imported.sfc",), ("a_imported_3.sfc",), ("a_imported_x.sfc",), ("a_imported_2.zip",)], "name string")
    got = {r.id: r.free_name for r in P.unique_names(wanted, taken).collect()}
    assert got == {1: "a_imported_2.sfc", 2: "a_imported_4.sfc", 3: "b_imported", 4: "a_imported.SFC"}
    assert P.unique_names(wanted.limit(0), taken).count() == 0


def test_keepers_without_hashes(spark):
    rows = [(1, "AB", "fuzzy", ".sfc", "x.sfc"), (2, "ab", "dat_verified", ".sfc", "longer.sfc"), (3, None, "fuzzy", ".sfc", "y"), (4, "", "fuzzy", ".sfc", "z"), (5, None, None, None, "q")]
    items = spark.createDataFrame(rows, "id long, sha1 string, match_confidence string, extension string, filename string")
    assert sorted(r.id for r in P.distinct_keepers(items).collect()) == [2, 3, 4, 5]


def test_resolutions(spark):
    plan = spark.createDataFrame([("collision", 1, 2, "/s", "/t"), ("collision", 3, None, "/u", "/v"), ("rename", 5, None, "/w", "/x")], "kind string, rom_id long, target_rom_id long, source_path string, target_path string")
    got = sorted(tuple(r)[:-1] for r in P.resolutions(plan, "replace_target").collect())
    assert got == [("/t", 0, "delete_file", 2, "/t", None), ("/t", 1, "rename", 1, "/s", "/t")]
    assert sorted(r.rom_id for r in P.resolutions(plan, "delete_source").collect()) == [1, 3]
    assert P.resolutions(plan, "do_nothing").count() == P.resolutions(plan, "odd").count() == 0
    assert sorted((r.collision, r.choice) for r in P.available_resolutions(plan).collect()) == [("/t", "delete_source"), ("/t", "do_nothing"), ("/t", "replace_target"), ("/v", "delete_source"), ("/v", "do_nothing")]


def test_a_changed_duplicate_stays(spark):
    items = spark.createDataFrame([(1, "/l/a", "s"), (2, "/l/b", "S"), (3, "/l/c", "other"), (4, "/l/d", None)], "id long, path string, sha1 string").withColumn("filename", F.substring_index("path", "/", -1))
    plan = spark.createDataFrame([("delete_duplicate", 2, "/l/b", "/l/a"), ("delete_duplicate", 3, "/l/c", "/l/a"), ("delete_duplicate", 4, "/l/d", "/l/gone"), ("rename", 1, "/l/a", "/l/c"), ("merge_folder", None, "/l", "/m"), ("collision", 9, "x", "y")], "kind string, rom_id long, source_path string, target_path string")
    outcome = E.organize_outcome(items, plan)
    assert {(r.kind, r.rom_id): r.outcome for r in outcome.collect()} == {("delete_duplicate", 2): "applied", ("delete_duplicate", 3): "failed", ("delete_duplicate", 4): "applied", ("rename", 1): "failed", ("merge_folder", None): "applied", ("collision", 9): "skipped"}
    assert sorted(r.path for r in E.organized(items, outcome).collect()) == ["/m/a", "/m/c"]
    assert E.organize_outcome(items, plan.limit(0)).count() == 0


def test_images_and_slashes(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nx"),), (bytearray(b"\xff\xd8\xff\xe1"),), (bytearray(b"GIF89a"),), (bytearray(b""),), (None,)], "c binary")
    assert [r[0] for r in df.select(U.is_image(F.col("c"))).collect()] == [True, True, False, False, False]
    items = spark.createDataFrame([(2, "a/b"), (1, "a\\b"), (3, None)], "id long, path string")
    assert [(r.path, r.id) for r in U.by_path(items, spark.createDataFrame([("a\\b",), ("z",)], "path string")).orderBy("path").collect()] == [("a\\b", 1), ("z", None)]
