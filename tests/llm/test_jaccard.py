import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import jaccard as J


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for k, s in enumerate(sets):
        groups.setdefault(s, []).append(k)
    distinct = sorted((s for s in groups if s), key=len)
    for ks in (groups[s] for s in distinct):
        for k in ks:
            root[find(k)] = find(ks[0])
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 10 * len(a) < 9 * len(b):
                break
            if 100 * len(a & b) >= 90 * len(a | b):
                root[find(groups[a][0])] = find(groups[b][0])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [(1, None), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "\xa0"), (None, "one two")], []
    for i in range(10, 10 + n):
        if rng.random() < 0.7 and texts:
            t = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.randint(0, 4)):
                x = rng.random()
                p = rng.randrange(len(t) + (x < 0.3))
                if x < 0.3:
                    t.insert(p, rng.choice(vocabulary))
                elif x < 0.5 and len(t) > 1:
                    del t[p]
                else:
                    t[p] = rng.choice(vocabulary)
            t = " ".join(t)
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 20, 30, 60, 200])))
        texts.append(t)
        rows.append((i, t if rng.random() < 0.8 else t.upper()))
    return rows + rows[-2:]


@pytest.mark.parametrize("block", [7, 2048])
def test_random(spark, block):
    rows = corpus(block, 300)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component_id string, h int")
    got = sorted(map(tuple, J.near_duplicates(df, block=block).collect()), key=str)
    assert got == brute(rows)
    kept = J.keep_first(df.where("doc_id is not null"), block=block)
    own = {i for i, _, c in brute([r for r in rows if r[0] is not None]) if i == c}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == own
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_index_paths():
    """Probing with skips and deriving from a similar set both give the true overlaps and links."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 10**6, 300)).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = rng.choice(base, len(base) - int(rng.integers(0, 30)), replace=False)
        sets.append(np.unique(np.concatenate([s, rng.integers(10**6, 2 * 10**6, int(rng.integers(0, 20))).astype(np.uint64)])))
    index = J.SetIndex(sets)
    true = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    sizes = index.sizes
    links = J.linked(true, sizes[:, None], sizes[None, :])
    for k in range(len(sets)):
        assert (index.overlaps(k) == true[k]).all()
        differ = np.setxor1d(index.of(k), index.of(0))
        assert (index.derived(k, 0, true[0], differ) == true[k]).all()
        near, overlap = index.probe(k)
        assert (overlap == true[k][near]).all() and set(np.flatnonzero(links[k])) <= set(near.tolist())
    u, v = index.links()
    assert links[u, v].all() and len(u) == links.sum() - len(sets)


def test_parts_never_miss():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 2**62, n)).astype(np.uint64)
        d = int(rng.integers(0, len(a) // 10 + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[d:], rng.integers(0, 2**62, int(rng.integers(0, d + 1))).astype(np.uint64)]))
        if J.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            key, doc = J.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert np.array_equal(a, b) or np.intersect1d(key[doc == 0], key[doc == 1]).size


def test_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op6_jaccard_join"](spark, tiny).collect()), key=str) == brute(rows)


def test_keep_first_is_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a, 1), (7, a, 2), (3, b, 3), (5, b + " more", 4), (5, c, 5), (None, a + " end", 6), (None, c + " end", 7), (None, "q r s", 8), (None, "Q r s", 9), (None, None, 10), (None, "", 11), (9, "only", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    kept = sorted(r["place"] for r in J.keep_first(df).collect())
    one, other = ([x for x in kept if x in group] for group in ((1, 2), (8, 9)))
    assert len(one) == len(other) == 1
    assert [x for x in kept if x not in (1, 2, 8, 9)] == [3, 5, 10, 11, 12]
    assert J.keep_first(df.where("doc_id is null and text is not null and text <> ''").withColumn("text", F.lit(a))).count() == 1


@pytest.mark.parametrize("block", [7, 2048])
def test_keep_first_of_any_rows(spark, block):
    """Nulls and repeats are kept in the input: one row of each group stays, whatever its id."""
    rows = [(i, t, k) for k, (i, t) in enumerate((None if x % 5 == 0 else i % 40, t) for x, (i, t) in enumerate((i or 0, t) for i, t in corpus(block + 1, 200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    groups, empty = {}, set()
    for k, _, c in brute([(k, t) for _, t, k in rows]):
        groups.setdefault(c, []).append(rows[k])
        if not shingle_set(rows[k][1]):
            empty.add(k)
    kept = [(r["doc_id"], r["place"]) for r in J.keep_first(df, block=block).collect()]
    assert len(kept) == len(groups) and empty <= {p for _, p in kept}
    of = {p: g for g in groups.values() for _, _, p in g}
    for i, p in kept:
        assert i == min((x for x, _, _ in of[p] if x is not None), default=None)
    assert len({id(of[p]) for _, p in kept}) == len(groups)


def test_one_large_family(spark):
    """Many near copies around two texts, in blocks of 16: the components are those of all pairs."""
    rng, rows = random.Random(3), []
    for k in range(260):
        w = [f"a{i}" for i in range(200)] if k % 4 else [f"a{i}" for i in range(188)] + [f"c{i}" for i in range(12)]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(df, block=16).collect()), key=str) == brute(rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 5), (2, "A b c d", 2, 6), (3, None, 3, 7)], "doc_id long, text string, __row int, __gone int")
    kept = J.keep_first(df)
    assert kept.columns == df.columns and sorted(r["__gone"] for r in kept.collect()) == [5, 7]


def test_blocks_follow_shingles(spark, monkeypatch):
    """Near copies of long texts fill a block by their shingles long before they do by their number; the result is that of all pairs."""
    rng, rows = random.Random(5), []
    for k in range(40):
        w = [f"a{i}" for i in range(500)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(500)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 3000)
    assert sorted(map(tuple, J.near_duplicates(df).collect()), key=str) == brute(rows)
    blocks = spark.createDataFrame([(1, 498)] * 40, "family int, n int").groupBy("family").agg(J._count(2048, F.col("n")).alias("b")).first().b
    assert blocks == 7


def test_a_block_is_searched_in_bounded_memory():
    """A pair of blocks of long near copies: peak memory of the search stays under 100 bytes a shingle."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20000).astype(np.uint64)
    sets = []
    for _ in range(50):  # a million shingles
        x = base.copy()
        x[rng.integers(0, len(x), 300)] = rng.integers(0, 2**63, 300)
        sets.append(np.unique(x))
    tracemalloc.start()
    u, v = J.SetIndex(sets).links()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(u) and peak < 100 * sum(map(len, sets))
