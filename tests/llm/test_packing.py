import itertools

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import packing, tokens

PATH = tokens.vocabulary("byte_bpe_50k.json")


def padded(lengths, counts, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        lengths = rng.choice(60, n, replace=False) + 1
        counts = rng.integers(1, 40, n)
        for k in (1, 2, 3, 12):
            best = min(padded(lengths, counts, (*c, max(lengths))) for r in range(min(k, n)) for c in itertools.combinations(sorted(lengths), r))
            ends = packing.boundaries(lengths, counts, k)
            assert len(ends) <= k and padded(lengths, counts, ends) == best
    assert packing.boundaries(np.array([]), np.array([]), 4) == []


def brute(rows, max_length, buckets, budget):
    tk = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        out += [(i, p, min(max_length, n - p * max_length)) for p in range(-(-n // max_length))]
    sizes, counts = np.unique([x[2] for x in out], return_counts=True)
    return out, padded(sizes, counts, packing.boundaries(sizes, counts, buckets))


def check(got, rows, max_length, buckets, budget):
    want, cost = brute(rows, max_length, buckets, budget)
    assert sorted(((r.doc_id, r.piece, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.bucket_length for r in got) == cost
    for b in {r.bucket for r in got}:
        mine = [r for r in got if r.bucket == b]
        fit = budget // mine[0].bucket_length
        assert sorted((r.batch, r.slot) for r in mine) == [(k // fit, k % fit) for k in range(len(mine))]
        assert all(r.n_tokens <= r.bucket_length for r in mine)


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_cases(spark, shard_rows):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (4, "x y z"), (4, "x y z"), *((i, "t " * (i % 17)) for i in range(10, 60))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, batch string")
    got = packing.pack_documents(df, PATH, max_length=64, buckets=4, budget=128, shard_rows=shard_rows).collect()
    check(got, rows, 64, 4, 128)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op2_length_buckets"](spark, tiny).collect(), rows, packing.MAX_LENGTH, packing.BUCKETS, packing.BUDGET)
