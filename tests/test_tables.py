import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import changes as C
from shelfspark.operators import pages as G
from shelfspark.operators import systems as Y


@pytest.mark.parametrize("order", [[("a", False), ("b", True), ("id", False)], [("b", True), ("a", True), ("id", True)], [("a", True), ("id", False)]])
def test_pages_cover_a_listing_with_nulls_and_ties(spark, order):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "x", "y", "Z"]), r.choice([None, 1.5, -2.0, 7.0])) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, a string, b double").cache()
    want = list(df.orderBy(*G.sort_columns(order)).collect())
    got, key = [], None
    while True:
        page = G.page(df, order, 10, key)
        key = G.last_key(page, order)
        if key is None:
            break
        got += page.collect()
    assert got == want


def test_a_page_is_a_top_k(spark):
    plan = G.page(spark.range(1000).withColumn("size_bytes", F.col("id") % 7), G.LARGEST_FIRST, 5, [3, 10])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_changes_tell_cleared_from_left_alone(spark):
    old = spark.createDataFrame([(1, "a", 5, None), (2, "b", 6, "t"), (3, "c", 7, None)], "id long, name string, size long, at string")
    rows = [(1, 1, {"name": "z", "size": "9"}), (1, 2, {"name": None}), (2, 1, {"other": "x"}), (4, 1, {"name": "new"}), (3, 5, {"size": "1"}), (3, 4, {"size": "2"})]
    edits = C.gathered(spark.createDataFrame(rows, "id long, seq long, fields map<string,string>"), ["id"], "seq")
    got = {r.id: (r.name, r.size, r.at) for r in C.changed(old, edits, ["id"], stamps={"at": F.lit("now")}).collect()}
    assert got == {1: (None, 9, "now"), 2: ("b", 6, "now"), 3: ("c", 1, "now")}
    got = {r.id: (r.name, r.size, r.at) for r in C.changed(old, edits, ["id"], insert=True, keep_nulls=True).collect()}
    assert got == {1: ("a", 9, None), 2: ("b", 6, "t"), 3: ("c", 1, None), 4: ("new", None, None)}


def test_a_reload_is_whole_or_nothing(spark):
    current = spark.createDataFrame([("a", "A")], "id string, display_name string")
    loaded = spark.createDataFrame([("f1", "b", "B", None), ("f1", "c", "C", None), ("f2", "c", "C2", "repeated_id")], "file string, id string, display_name string, problem string")
    registry, problems = Y.reload(current, loaded)
    assert [tuple(r) for r in registry.collect()] == [("a", "A")] and [r.file for r in problems.collect()] == ["f2"]
    registry, problems = Y.reload(current, loaded.where("file = 'f1'"))
    assert sorted(r.id for r in registry.collect()) == ["b", "c"] and problems.isEmpty()
    after, added = Y.seed(current.withColumn("id", F.lit("b")), registry)
    assert sorted(map(tuple, after.collect())) == [("b", "A"), ("c", "C")] and [r.id for r in added.collect()] == ["c"]
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, system_id string")
    assert [r.id for r in Y.orphans(items, registry).collect()] == [1]
