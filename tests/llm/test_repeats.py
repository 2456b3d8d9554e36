import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shelfspark.llm import substring, suffix
from shelfspark.llm.repeats import Levels, Rule, repeated_windows


def brute_bytes(rows, width):
    starts = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - width + 1):
            starts[b[s : s + width]] += 1
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if starts[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def check_shared(rows, df, rule):
    """n_shared of distinct rows against what other rows have."""
    window, gram = rule.scout
    data = [(i, (t or "").encode()) for i, t in rows]
    holders = {w: defaultdict(set) for w in (window, gram)}
    for w, by in holders.items():
        for k, (_, b) in enumerate(data):
            for s in range(len(b) - w + 1):
                by[b[s : s + w]].add(k)
    got = defaultdict(set)
    for r in df.collect():
        got[r["doc_id"]].add(r["n_shared"])
    seen = set()
    for i, b in data:
        long = any(len(holders[window][b[s : s + window]]) > 1 for s in range(len(b) - window + 1))
        some = any(len(holders[gram][b[s : s + gram]]) > 1 for s in range(len(b) - gram + 1))
        assert len(got[i]) == 1 and (not long or min(got[i]) >= gram) and (some or got[i] == {0})
        seen.add((long, some))
    return seen


def brute_words(rows, width):
    least = {}
    data = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    low = lambda i: -(2**70) if i is None else i
    for i, w in data:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, low(i)), low(i))
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < low(i):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, parts, join):
    """Random texts, copies, near copies, shared passages, repetitions."""
    rng = random.Random(seed)
    make = lambda k: join.join(rng.choice(parts) for _ in range(k))
    passages = [make(rng.randint(5, 40)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, passages[0])]
    texts = []
    for i in range(10, 10 + n):
        x = rng.random()
        if x < 0.15 and texts:
            t = rng.choice(texts)
        elif x < 0.35 and texts:
            t = rng.choice(texts)
            t = t.split(join) if join else list(t)
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(parts)
            t = join.join(t)
        elif x < 0.8:
            t = join.join([make(rng.randint(1, 30)), rng.choice(passages), make(rng.randint(1, 30))])
        else:
            t = join.join([rng.choice(parts)] * rng.randint(1, 50))
        texts.append(t)
        rows.append((i, t))
    return rows + [rows[-1], rows[5]]


@pytest.mark.parametrize("seed", range(3))
def test_bytes_small_windows(spark, seed):
    rows = corpus(seed, 60, ["a", "b", "c", "é", "日"], "")
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, n_spans boolean")
    rule = Rule(9, 4, False, (6, 3))
    got = suffix.suffix_dedup(df, rule=rule, shard_bytes=200)
    assert digests(got) == brute_bytes(rows, 9)
    assert len(check_shared(rows, got, rule)) > 1
    assert digests(suffix.suffix_dedup(df, rule=Rule(9, 4, False), shard_bytes=200)) == brute_bytes(rows, 9)


@pytest.mark.parametrize("seed", range(3))
def test_words_small_windows(spark, seed):
    rows = corpus(seed, 80, ["aa", "b", "é", "dd", "x,", "y"], " ")
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, n_words boolean")
    got = substring.substring_dedup(df, rule=Rule(5, 2, True), shard_bytes=200)
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows, 5)


def test_production_rules(spark):
    rows = corpus(9, 60, [f"word{i}" for i in range(300)], " ") + [(900, "z" * 3000), (901, "y" * 401), (902, "q " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.substring_dedup(df).collect()), key=str) == brute_words(rows, 13)
    rows = rows[:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffix.suffix_dedup(df)) == brute_bytes(rows, 400)
    for f in (substring.substring_dedup, suffix.suffix_dedup):
        assert f(df.limit(0)).count() == 0


def test_remove_repeats(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a\n{p}\nb", 9, "u"), (2, f"c  d\n{p} e\nf", 9, None), (3, p, 9, "v"), (4, "clean\n text ", 12, "w"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    got = sorted(map(tuple, substring.remove_repeats(df).collect()))
    assert got == [rows[0], (2, "c  d\ne\nf", 8, None), rows[3], (5, None, None, None)]


def test_queries(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op9_substring_dedup"](spark, tiny).collect()), key=str)
    assert got == brute_words(rows, 13) and any(r[2] for r in got)
    out = QUERIES["op3_suffix_dedup"](spark, tiny).cache()
    got = digests(out)
    assert got == brute_bytes(rows, 400) and any(r[2] for r in got)
    check_shared(rows, out, suffix.RULE)


def test_one_id_for_all(spark):
    """Null and equal ids are dealt by text; column names that the operators use themselves."""
    rows = [(None if k % 3 else 7, t) for k, (_, t) in enumerate(corpus(5, 60, ["aa", "b", "é", "dd", "x,", "y"], " "))]
    df = spark.createDataFrame([(*r, "u", k, 0.5) for k, r in enumerate(rows)], "doc_id long, text string, __id string, __shard long, __text double").repartition(3)
    assert sorted(map(tuple, substring.substring_dedup(df, rule=Rule(5, 2, True), shard_bytes=200).collect()), key=str) == brute_words(rows, 5)
    assert digests(suffix.suffix_dedup(df, rule=Rule(9, 4, False, (6, 3)), shard_bytes=200)) == brute_bytes(rows, 9)
    kept = substring.remove_repeats(df, rule=Rule(5, 2, True), shard_bytes=200)
    assert kept.columns == df.columns and {r["__shard"] for r in kept.collect()} <= set(range(len(rows)))


def test_levels():
    """Batches are scanned against what is there, keys are held once, and levels grow geometrically."""
    rng = random.Random(8)
    family, seen, sizes = Levels(), {}, []
    for k in range(64):
        run = sorted({(rng.randrange(900), rng.randrange(3)) for _ in range(20)})
        a, b = (np.array(x, np.uint64) for x in zip(*run, strict=True))
        known = family.add(a, b, np.full(len(run), 100 - k))
        assert known.tolist() == [x in seen for x in run]
        for x in run:
            n, least = seen.get(x, (0, 1000))
            seen[x] = (n + 1, min(least, 100 - k))
        sizes.append([len(x[0]) for x in family.levels])
        assert all(one > 2 * two for one, two in zip(sizes[-1], sizes[-1][1:]))
    assert sum(sizes[-1]) == len(seen) and max(map(len, sizes)) <= 7
    a, b, least, count = family.compacted()
    assert list(zip(a.tolist(), b.tolist(), count.tolist(), least.tolist(), strict=True)) == [(*x, *seen[x]) for x in sorted(seen)]


def test_texts_are_dealt_by_bytes(spark, monkeypatch):
    """Where the session has too few partitions for the texts, they are dealt to more; the result is the same."""
    from shelfspark.llm import common

    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + (" " + shared if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring.substring_dedup(df, shard_bytes=2000).collect()))
    monkeypatch.setattr(common, "TASK_BYTES", 3000)
    out = repeated_windows(df, substring.RULE, substring._read, substring.digest_rows, substring.DIGEST, symbol_bytes=substring.WORD_BYTES, shard_bytes=2000, index_bytes=3000)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == want and sum(r[2] > 0 for r in want) == 19
