import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as brute_contamination  # noqa: E402
from test_jaccard import brute as brute_links  # noqa: E402
from test_packing import check as check_packing  # noqa: E402
from test_quality import brute as brute_quality  # noqa: E402

from shelfspark.llm import packing, quality  # noqa: E402


def cut_words(rows, width=13):
    least, data = {}, [(i, [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", t)], t) for i, t in rows]
    for i, w, t in data:
        for s in range(len(w) - width + 1):
            k = tuple(t[a:b] for a, b in w[s : s + width])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w, t in data:
        gone = set()
        for s in range(len(w) - width + 1):
            if least[tuple(t[a:b] for a, b in w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            ends = [a for a, _ in w[1:]] + [len(t)]
            out[i] = (t[: w[0][0]] + "".join(t[a:e] for k, ((a, _), e) in enumerate(zip(w, ends, strict=True)) if k not in gone)).rstrip(" \t\n\v\f\r")
    return out


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]

    def apply(name):
        nonlocal docs
        out = stages[name](spark, docs, tiny)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        return rows

    references = quality.fit_references(docs)
    kept = {r["doc_id"]: r["text"] for r in apply("quality rules")}
    verdict = {r[0]: r[-1] for r in brute_quality(texts.items(), references)}
    assert kept == {i: t for i, t in texts.items() if verdict[i]} and len(kept) < len(texts)

    before = kept
    kept = {r["doc_id"]: r["text"] for r in apply("n-gram Jaccard join")}
    assert kept == {i: before[i] for i, _, c in brute_links(list(before.items())) if i == c} and len(kept) < len(before)

    before = kept
    rows = apply("substring dedup")
    kept = {r["doc_id"]: r["text"] for r in rows}
    assert kept == cut_words(list(before.items())) and kept != before and all(r["n_chars"] == len(r["text"]) for r in rows)

    before = kept
    kept = {r["doc_id"]: r["text"] for r in apply("benchmark decontamination")}
    bad = {r[0] for r in brute_contamination(list(before.items()), items) if r[-1]}
    assert kept == {i: t for i, t in before.items() if i not in bad} and bad

    check_packing(apply("packing"), list(kept.items()), packing.MAX_LENGTH, packing.BUCKETS, packing.BUDGET)
    want = sorted(map(tuple, docs.select("doc_id", "piece", "n_tokens", "bucket", "bucket_length", "batch", "slot").collect()))
    assert sorted(map(tuple, pipeline.run(spark, tiny).collect())) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, __id long, __text string, __row int, __gone int, c0 int, dest int"


def test_stages_take_odd_rows(spark, tiny):
    """Null and repeated ids, null, empty and very long texts, repeated rows, columns with the names that stages use: no stage fails or loses a clean row."""
    prose = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 900 AND 3000").orderBy("doc_id").limit(12).collect()]
    long = " ".join(f"{a}{k}" for k in range(9000) for a in ("word", "line", "text", "of", "the", "and"))
    rows = [(None if k % 4 == 0 else k % 5, t) for k, t in enumerate(prose)] + [(1, prose[0]), (1, prose[0]), (None, None), (9, None), (10, ""), (11, " \n"), (12, long)]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", "s", len(t or ""), k, "x", 1, 2, 3, 4) for k, (i, t) in enumerate(rows)], ODD)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tiny)
        got = out.collect()
        if name != "packing":
            assert out.dtypes == docs.dtypes
            kept = {r["text"] for r in got}
            if name == "n-gram Jaccard join":
                assert {t for t in prose if t in {x for _, x in rows}} >= kept & set(prose) and len(kept & set(prose)) >= 1
            if name == "quality rules":
                assert not kept & {None, "", " \n"}
            docs = spark.createDataFrame(got, out.schema)
        else:
            assert got


def test_stages_take_an_empty_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert out.count() == 0
