import hashlib
import math
import random
import re
import zlib

import pytest

resample = pytest.importorskip("shelfspark.llm.resample")


def found(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, percent=10, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in found(text, longest)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows, order = [], []
    for n, (i, text) in enumerate(docs):
        w, f = found(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= least:
            order.append((-rows[-1][3], i is None, i or 0, n))
    for r, (*_, n) in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        rows[n][4] = r
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS segment", "2 AS row", "3 AS score", "4 AS rank")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in resample.resample(d, t, **more).collect()), key=str)


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "öl", "ÄRA", "x9", "日本語", "a_b", "don't"] + [f"w{i}" for i in range(300)]
    out = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 19, 20, 21, 90])))) for i in range(n)]
    out += [(5, out[5][1]), (5, out[5][1]), (None, out[7][1]), (None, None), (n + 1, ""), (n + 2, "! ?"), (n + 3, "lang " * 60000 + "z" * 5000)]
    return out, [" ".join(r.choice(vocabulary[:30]) for _ in range(40)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("longest", [1, 2])
def test_equals_brute_force(spark, longest):
    docs, target = corpus(400)
    assert run(spark, docs, target, longest=longest) == brute(docs, target, longest)


def test_many_segments_and_ties(spark):
    docs, target = corpus(500, 2)
    docs += [(900, docs[3][1])] * 200
    assert run(spark, docs, target, segment_rows=20, percent=100) == brute(docs, target, percent=100)


def test_empty_tables(spark):
    docs, target = corpus(30)
    assert run(spark, [], target) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_splitters_part_evenly(spark):
    rows = spark.range(0, 20000, numPartitions=7).selectExpr("id % 5 AS score", "id AS doc_id", "id AS row").sortWithinPartitions("score", ascending=False)
    runs = rows.sortWithinPartitions(rows.score.desc(), "doc_id", "row")
    split = resample.splitters(runs, 20000, 10)
    keys = sorted(resample._key(*r) for r in rows.collect())
    at = [0, *(keys.index(s) for s in split), len(keys)]
    assert len(split) == 9 and max(b - a for a, b in zip(at, at[1:])) <= 20000 / 10 + 7 * 200
