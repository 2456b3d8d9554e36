import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate as D


def brute(docs, items):
    out = []
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [(1, LONG), (2, "x " * 40 + LONG[:60]), (3, None), (4, ""), (5, "Alpha BETA gamma"), (5, "Alpha BETA gamma"), (6, "w3-w4,w5 " + LONG), (7, "q " * 5000 + LONG + " z"), (None, "alpha beta gamma delta"), (8, "été " * 14)]
ITEMS = [(1, LONG), (2, "alpha beta"), (2, "alpha beta"), (10, "beta gamma"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(8, 24))), (6, "été " * 13), (7, "q q q")]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_cases(spark, most):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(*r, 1.0) for r in ITEMS], "item_id long, text string, doc_id double")
    assert sorted(map(tuple, D.contamination(docs, items, most_bytes=most).collect()), key=str) == brute(DOCS, ITEMS)
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    kept = D.drop_contaminated(docs.where("doc_id is not null"), items, most_bytes=most)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in DOCS if i is not None and i not in bad)
    assert D.contamination(docs, items.limit(0), most_bytes=most).where("contaminated").count() == 0
    assert D.contamination(docs.limit(0), items, most_bytes=most).count() == 0


def test_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    docs, items = ([tuple(r) for r in spark.read.parquet(f"{tiny}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted(map(tuple, QUERIES["op5_winnowing"](spark, tiny).collect()), key=str)
    assert got == brute(docs, items) and any(r[5] for r in got)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_null_and_repeated_ids(spark, most):
    """Each row is judged by itself, and null item ids count alike, whatever the size of the benchmark."""
    rows = [(None, LONG), (None, "clean of all that"), (None, None), (5, LONG), (5, "clean too"), (5, "clean too"), (6, "Alpha beta"), (6, "Alpha beta"), (7, "delta epsilon zeta")]
    items = [(1, LONG), (None, LONG), (None, "alpha beta"), (None, "alpha beta"), (None, "epsilon zeta")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, place int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert sorted(map(tuple, D.contamination(docs, bench, most_bytes=most).collect()), key=str) == want and max(r[3] for r in want) == 2
    kept = D.drop_contaminated(docs, bench, most_bytes=most)
    assert kept.columns == docs.columns and sorted(r["place"] for r in kept.collect()) == [1, 2, 4, 5]


def test_drop_is_the_same_at_every_size(spark):
    """Rows without an id, and rows that share one, are judged each; names that the operator uses itself."""
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "see " + item, 0), (1, "clean text", 1), (None, item, 2), (None, "also clean", 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int").withColumn("__bad", F.lit("x"))
    tests = spark.createDataFrame([(9, item), (None, "q r s")], "item_id long, text string")
    for most in (0, D.MOST_BYTES):
        kept = D.drop_contaminated(df, tests, most_bytes=most)
        assert kept.columns == df.columns and sorted(r["__row"] for r in kept.collect()) == [1, 3, 4]
        judged = sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in D.contamination(df, tests, most_bytes=most).collect())
        assert judged == [(0, 0, False), (2, 0, False), (2, 0, False), (20, 20, True), (21, 20, True)]
