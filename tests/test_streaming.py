"""The streamed catalogue against one merge after another."""

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from shelfspark.streaming.catalogue import follow, run_available, snapshot

SCHEMA = StructType([StructField("path", StringType()), StructField("title", StringType()), StructField("match_confidence", StringType()), StructField("size_bytes", LongType()), StructField("missing", BooleanType()), StructField("mtime", LongType())])


def state(df):
    return {r.path: (r.title, r.match_confidence, r.size_bytes) for r in df.collect()}


def test_batches_merge_and_run_again(spark, tmp_path):
    root, src = str(tmp_path / "cat"), str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put([("a", "A", "header", 1, False, 1), ("a", "B", "header", 2, False, 2), ("b", "C", "fuzzy", 3, False, 1), (None, "x", "fuzzy", 3, False, 1)])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    assert state(run_available(stream(), root, order="mtime")) == {"a": ("B", "header", 2), "b": ("C", "fuzzy", 3)}
    put([("a", None, "fuzzy", 9, False, 3), ("c", "D", "fuzzy", 1, False, 3)])
    want = {"a": ("B", "header", 9), "b": ("C", "fuzzy", 3), "c": ("D", "fuzzy", 1)}
    assert state(run_available(stream(), root, order="mtime")) == want
    assert state(run_available(stream(), root, order="mtime")) == want


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    base = spark.createDataFrame([(f"p{i}", "t", "fuzzy", i, False, 1) for i in range(20)], SCHEMA)
    more = spark.createDataFrame([("p1", "u", "fuzzy", 100, False, 2)], SCHEMA)
    step = follow(base, root, order="mtime")
    now = lambda: state(snapshot(spark, root, StructType([f for f in SCHEMA if f.name != "mtime"])))
    assert now() == {}
    step(base, 0)
    step(more, 1)
    once = now()
    assert len(once) == 20 and once["p1"] == ("u", "fuzzy", 100)
    step(more, 1)
    assert now() == once
