"""Work that grows with rows: it is dealt to tasks, and each row's texts are parsed once."""

import contextlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfspark.functions import content as B
from shelfspark.functions import names as N
from shelfspark.operators import enrich as E
from shelfspark.operators import providers as P
from shelfspark.sources import profiles as Y
from shelfspark.sources import sinks as K
from shelfspark.sources import tree as T


def parses(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


@pytest.mark.parametrize("query", ["id_list_resolve", "included_names", "answer_fields"])
def test_rows_of_one_file_go_to_several_tasks(spark, tiny, query):
    assert entry.queries()[query](spark, tiny).select(F.spark_partition_id()).distinct().count() > 1


def test_local_covers_deals_its_items_to_tasks(spark, tiny):
    assert "Repartition " in entry.queries()["local_covers"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()


def test_included_names_are_parsed_once_for_a_list(spark):
    answer = '{"include":{"genres":{"1":{"name":"A"},"2":{"name":""}}},"data":{"game":{"genre":[],"genres":[1, 2, null, ""]}}}'
    df = spark.createDataFrame([(answer,), ('{"data":{"game":{"genre":"x"}}}',), ('{"data":{"game":{"genres":[""]}}}',), (None,)], "a string").coalesce(1)
    out = df.select(P.listed_names(F.get_json_object("a", "$.data.game"), ["genre", "genres"], P.include_names(F.col("a"), "genres")).alias("n"))
    assert [r.n for r in out.collect()] == ["A, 2", "x", None, None]
    assert parses(out, "from_json") <= 6  # for each of two fields: the list, and the block at either of its places


def test_an_answer_looks_for_its_wrapper_once(spark):
    answers = ['{"title":"","name":"T","genres":["a", "b"],"esrb":null}', '{"game":{"name":"G","released":"1999"},"title":"other"}', '{"game":"none","data":{"summary":"D"}}', None, "{"]
    df = spark.createDataFrame([(a,) for a in answers], "a string").coalesce(1)
    out = df.withColumn("f", P.answer_struct(F.col("a"))).select("f.*")
    empty = dict.fromkeys(P.SYNONYMS)
    assert [r.asDict() for r in out.collect()] == [empty | f for f in ({"title": "T", "genre": '["a","b"]'}, {"title": "G", "release_date": "1999"}, {"description": "D"}, {}, {})]
    assert [r.asDict() for r in df.select(*(c.alias(n) for n, c in P.answer_fields(F.col("a")).items())).collect()] == [r.asDict() for r in out.collect()]
    assert parses(out, "get_json_object") == len(P.WRAPPERS) + sum(map(len, P.SYNONYMS.values()))


def test_keys_take_names_apart_once(spark):
    rows = [("/l/Family, The II (NSO).sfc", "thefamily2__nso", "Family, The II"), ("/l/The.sfc", "", None), ("/l/A  Game v1.2.sfc", None, "A Game"), (None, None, None)]
    df = spark.createDataFrame(rows, "path string, fuzzy_key string, clean_name string").coalesce(1)
    out = df.select(E.candidate_keys(F.col("path"), F.col("fuzzy_key"), F.col("clean_name")).alias("k"))
    assert [r.k for r in out.collect()] == [["thefamily2", "familythe2", "thefamily2__nso", "familythe2__nso"], [], ["game"], []]
    assert parses(out, "regexp_replace") <= 11
    keys = df.select(N.fuzzy_key(F.col("clean_name")).alias("k"))
    assert parses(keys, "regexp_replace") <= 3


def test_registry_files_are_parsed_once(spark, tmp_path):
    book = tmp_path / "a.yaml"
    book.write_text("systems:\n  - {id: a, display_name: A, short_name: S, extensions: [.X]}\n  - {id: b}\n")
    systems = Y.registry_systems(spark, str(tmp_path))
    book.unlink()
    assert sorted((r.id, r.ord, r.extensions, r.problem) for r in systems.collect()) == [("a", 0, [".x"], None), ("b", 1, [], "incomplete")]


def test_books_share_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x\n"), (1, "x\n"), (7, "y\n"), (1002, "z\n")], "book long, entry string")
    K.write_books(rows, str(tmp_path / "b"), "h\n")
    K.write_books(rows.limit(0), str(tmp_path / "none"), "h\n")
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*.yaml")} == {"b/shelf=0/1.yaml": "h\nx\nx\n", "b/shelf=0/7.yaml": "h\ny\n", "b/shelf=1/1002.yaml": "h\nz\n"}
    assert spark.read.text(str(tmp_path / "b"), wholetext=True).count() == 3
    assert Y.registry_systems(spark, str(tmp_path / "none")).count() == 0


def test_folders_are_listed_as_they_come(tmp_path, monkeypatch):
    for name in ("a/x", "a/b/y", "z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    real, calls = os.scandir, []
    monkeypatch.setattr(os, "scandir", lambda folder: calls.append(folder) or real(folder))
    assert sorted(r[1] for r in T.Walk().below(str(tmp_path), str(tmp_path))) == ["a/b/y", "a/x", "z"]
    assert len(calls) == 3

    def endless(folder):
        @contextlib.contextmanager
        def entries():
            with real(tmp_path / "a") as found:
                file = next(e for e in found if e.name == "x")

            def more():
                yield file
                raise AssertionError("the whole folder is held")

            yield more()

        return entries()

    monkeypatch.setattr(os, "scandir", endless)
    assert next(T.Walk().files(str(tmp_path), str(tmp_path / "a")))[1:3] == ("a/x", "x")


def test_titles_send_only_heads_to_python(spark):
    big = b"\x80\x37\x12\x40" + b"x" * 28 + b"GAME  ONE".ljust(20) + b"y" * 7
    pairs = lambda b: b"".join(b[i : i + 2][::-1].ljust(2, b"\0") for i in range(0, len(b), 2))
    words = lambda b: b"".join((b[i : i + 4] + b"\0" * 3)[:4][::-1] for i in range(0, len(b), 4))
    contents = [big, pairs(big + b"z"), words(big + b"z"), pairs(big[:52]), pairs(big[:50]), b"x" * 80, None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None, "n64") for i, c in enumerate(contents)], "i int, content binary, system string")
    out = df.select("i", B.inner_title(F.col("content"), F.col("system")).alias("t"))
    assert [r.t for r in out.orderBy("i").collect()] == ["GAME ONE", "GAME ONE", "GAME ONE", "GAME ONE", None, None, None]
    assert "big_endian(content" not in out._jdf.queryExecution().optimizedPlan().toString()
