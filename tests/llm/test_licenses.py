import re

import numpy as np
import pyarrow as pa

from shelfspark.llm import licenses as L
from shelfspark.llm.arrays import chunks

NOTICE = L.TEMPLATES["GPL-3.0"]
TEXT = L.TEMPLATES["MIT-text"]
ROWS = [(1, None), (2, ""), (3, NOTICE), (3, NOTICE), (4, "a b c " * 3000 + NOTICE.upper() + " d e" * 500), (5, TEXT.replace("free of charge", "gratis")), (6, "licensed under cc"), (7, " ".join(TEXT.split()[:12])), (None, "Released under the MIT License. " * 3 + NOTICE), (8, "plain words only " * 50)]


def brute(rows, templates=None):
    index, out = L.TemplateIndex(L.TEMPLATES if templates is None else templates), []
    for i, t in rows:
        for _, _, data, offsets in chunks(pa.array([t], pa.string())):
            f = index.scan(data, offsets, most_missing=False)[0]
            out.append((i, len(f), [index.names[k] for k in sorted(f)], max(f.values(), default=0.0)))
    return sorted(out, key=str)


def test_cases(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, licenses string")
    got = sorted(map(tuple, L.license_scan(df).collect()), key=str)
    assert got == brute(ROWS)
    names = {r[0]: r[2] for r in got}
    assert names[3] == names[4] == ["GPL-3.0"] and names[5] == ["MIT-text"] and names[None] == ["GPL-3.0", "MIT"] and not names[7] and not names[8]
    assert L.license_scan(df, {}).where("n_licenses > 0").count() == 0
    assert L.license_scan(df.limit(0)).count() == 0


def test_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op10_license_scan"](spark, tiny).collect()), key=str) == brute(rows)


def plain_scan(text, templates):
    """Containment by sets of words alone, in stretches of four half windows that start a half window apart."""
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    own, out = grams(words(text)), {}
    for name, t in templates.items():
        want, half = set(grams(words(t))), 1
        while half < len(want):
            half *= 2
        for w in range(-(-len(own) // half)):
            share = len(want & set(own[max(0, (w - 1) * half) : (w + 3) * half])) / len(want)
            if share >= 0.8:
                out[name] = max(out.get(name, 0), share)
    return len(out), sorted(out), max(out.values(), default=0.0)


def test_against_plain_sets(spark, tiny):
    """Retrieval, shingles, windows and containment against another way to find them, over the whole table."""
    from shelfspark.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_license_scan"](spark, tiny).collect()}
    assert got == {i: plain_scan(t, L.TEMPLATES) for i, t in texts.items()} and any(x[0] for x in got.values())
    cases = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in L.license_scan(cases).collect()} == {k: plain_scan(t, L.TEMPLATES) for k, (_, t) in enumerate(ROWS)}


def test_misses_are_rare():
    """The band setting's promise at the least similarity it is made for."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        template = rng.integers(0, 2**63, 10).astype(np.uint64)
        window = np.concatenate([template, rng.integers(0, 2**63, 30).astype(np.uint64)])
        missed += not any((template * L._ODD[b]).min() == (window * L._ODD[b]).min() for b in range(L.BANDS))
    assert missed == 0
