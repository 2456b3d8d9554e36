import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import huffman, tokens
from shelfspark.llm.arrays import chunks

PATH = tokens.vocabulary("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "2", "!", "é", "ß", "日", "don't", " 's", "x'S", "٣", "😀", "\x1c", "\x85", "<|endoftext|>", "'tis"]
ROWS = [(1, "a b"), (2, None), (3, ""), (4, "x " * 70000), (4, "x " * 70000), (None, "null id"), (6, "<|endoftext|> I'm here\n\n  'tis"), (5, "y" * 200000), (0, "dup"), (0, "dup")]


def test_pieces_equal_library():
    rng, encoder = random.Random(5), tokens.PieceEncoder(PATH)
    for _ in range(400):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(6)]
        _, _, data, offsets = next(chunks(pa.array(texts)))
        ids, at = encoder.encode(data, offsets)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        assert encoder.count(data, offsets).tolist() == [len(x) for x in want]


def test_a_single_long_text():
    """A text that fills more than a batch is counted in parts."""
    rng, encoder = random.Random(6), tokens.PieceEncoder(PATH)
    for t in ("word 12,3 don't  x\n\n" * 40000, "é" * 300000, " " * 600000 + "x", "".join(rng.choice(PARTS[:20]) for _ in range(400000))):
        data = np.frombuffer(t.encode(), np.uint8)
        parts = [bytes(x) for x, _ in tokens.split_long(data, np.array([0, len(data)]), 1 << 18)]
        assert b"".join(parts) == bytes(data)
        assert encoder.count(data, np.array([0, len(data)])).tolist() == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)]


def test_any_key_name(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "__text long, text string")
    assert sorted(map(tuple, tokens.token_counts(df, PATH, keys=("__text",)).collect())) == [(1, 3, 2, False), (2, 0, 0, False)]


def test_safe_pieces():
    for t in ("ab cd\nef  gh" * 30, "x" * 100, "", "   " * 40):
        assert "".join(tokens.safe_pieces(t, 7)) == t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = tokens.vocabulary(name)
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(df, path).collect()), key=str)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 512) for i, t in ROWS]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(df.limit(0), path).count() == 0


def brute_ids(rows):
    tk, out, at = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_huffman_files(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, start int")
    assert sorted(map(tuple, huffman.huffman_ids(df, PATH, file_ids=1000).collect()), key=lambda r: r[1]) == brute_ids(ROWS)
    assert huffman.huffman_ids(df.limit(0), PATH).count() == 0


def test_huffman_query(spark, tiny):
    from shelfspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op7_token_id_files"](spark, tiny).collect())) == brute_ids(rows)


def test_package_merge_and_round_trip():
    rng = np.random.default_rng(1)
    for n, limit in ((2, 4), (9, 4), (300, 9), (5000, 18)):
        counts = (rng.pareto(0.6, n) * 3).astype(np.int64)
        counts[:2] += 1
        lengths = huffman.code_lengths(counts, limit)
        used = counts > 0
        assert (lengths[used] > 0).all() and lengths.max() <= limit and (lengths[~used] == 0).all()
        assert sum(0.5 ** int(x) for x in lengths[used]) <= 1
        if limit == 18:
            ids = rng.choice(np.flatnonzero(used), 200_000, p=counts[used] / counts.sum()).astype(np.uint32)
            raw = huffman.pack_file(np.arange(2), np.zeros(2), np.array([5, len(ids) - 5]), ids, huffman.canonical_codes(lengths), lengths)
            assert (huffman.unpack_file(raw, huffman.decode_table(lengths))[3] == ids).all()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c),) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap)[0] + heapq.heappop(heap)[0]
        cost += s
        heapq.heappush(heap, (s,))
    assert int((huffman.code_lengths(counts, 18) * counts).sum()) == cost


def test_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from shelfspark.llm.common import ARROW_BYTES, bounded_batches

    bounded_batches(spark)
    rows = spark.range(60).coalesce(1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("t"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < int(ARROW_BYTES) + (2 << 20)


def test_the_cache_is_bounded_in_bytes():
    """Many long pieces: the cache is emptied, and counts stay those of the library."""
    from shelfspark.llm import tokens

    encoder = tokens.PieceEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(20)) for _ in range(12)]
    before, tokens.CACHE_BYTES = tokens.CACHE_BYTES, 200_000
    try:
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            offsets = np.array([0, len(data)])
            ids = encoder.tokenizer.encode(t, add_special_tokens=False).ids
            assert encoder.count(data, offsets).tolist() == [len(ids)]
            assert encoder.encode(data, offsets)[0].tolist() == ids
            assert encoder.held < 200_000 + 2 * 60_000 * 5
    finally:
        tokens.CACHE_BYTES = before


def test_long_texts_are_encoded_in_parts():
    from shelfspark.llm import tokens

    encoder = tokens.PieceEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    for text in ("lorem ipsum, dolor 12 " * 60_000, "日本語テキスト。" * 40_000, "x" * 700_000):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = encoder.encode(data, np.array([0, len(data)]))
        assert at.tolist() == [0, len(ids)] and len(ids) == encoder.count(data, np.array([0, len(data)]))[0]
        assert encoder.tokenizer.decode(ids.tolist()) == text
