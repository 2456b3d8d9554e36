import math
import random

import pytest

topk = pytest.importorskip("shelfspark.llm.topk")
from pyspark.sql import functions as F  # noqa: E402


def brute(rows, every, k=5, scale=256):
    out = []
    good = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, i, q in good:
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for m, j, v in good if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, every, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS row", "2 AS v", "3 AS asks", "4 AS c", "5 AS query")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, **more).collect())


def test_blocks_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.0, r.gauss(0, 0.3)]) for _ in range(r.choice([8, 8, 5]))]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, rows, 10, block_rows=37, query_rows=9) == brute(rows, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf")]), (250, []), (None, [3.0, 3.0]), (3, [-1.0, -1.0, 7.0]), (4, [1.0, 2.0])]
    assert run(spark, rows, 50) == brute(rows, 50)
    assert {i for i, *_ in run(spark, rows, 50)} == {0, 250}
    assert run(spark, [], 50) == [] and run(spark, [(0, [1.0])], 50) == []


def test_scores_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 0.5]), (2, [-3e38, 0.0]), (3, [1e-3, 1.0]), (4, [1e16, 1e16]), (50, [1e16, 2e-3])]
    assert run(spark, rows, 50) == brute(rows, 50)
    assert run(spark, rows, 50, block_rows=2, query_rows=1) == brute(rows, 50)
