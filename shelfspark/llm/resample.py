"""Importance resampling towards a target corpus: bucket gains, array-scored weights, and exact ranks by sorting with regular samples."""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfspark.llm.arrays import LOWER, NOT_ALNUM, chunks, words
from shelfspark.llm.common import bounded_batches, shared_dir, stored, unused

BUCKETS = 10000
#: A segment of the sort holds about so many rows, and there are at most so many segments, so that their samples fit the driver.
SEGMENT_ROWS, MOST_SEGMENTS = 1 << 20, 512


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_BLANK = 0x20


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span, byte after byte over all spans that are that long."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    live = len(at)
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left[:live], -j, "left"))  # spans longer than j come first
        c = crc[:live]
        crc[:live] = _CRC[(c ^ data[at[:live] + j]) & 0xFF] ^ (c >> 8)
        if live <= 4:  # the rest of a few very long ones
            for i in range(live):
                a = int(at[i])
                crc[i] = zlib.crc32(data[a : a + int(left[i])].tobytes()) ^ 0xFFFFFFFF
            break
    out = np.empty(len(at), np.uint32)
    out[order] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, documents' offsets into them): runs of 1 to ``longest`` consecutive words, joined by one blank."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, NOT_ALNUM)
    if longest > 1:  # words laid end to end with one blank after each, so that a run is a span
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(int(to[-1]), _BLANK, np.uint8)
        flat[np.repeat(to[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        data, starts, ends = flat, to[:-1], to[:-1] + size
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, of = [], []
    for n in range(1, longest + 1):
        whole = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
        found.append(crc32s(data, starts[whole], ends[whole + n - 1]) % np.uint32(n_buckets))
        of.append(doc[whole])
    owner = np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(at)))


def bucket_counts(docs: DataFrame, *, longest: int = 1, n_buckets: int = BUCKETS, text_column: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has. Every task adds up its own rows; n_buckets numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(features(data, offsets, longest, n_buckets)[0], minlength=n_buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for bucket, n in docs.select(text_column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's), by bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln u)) of the id's own u between 0 and 1; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, *, longest: int = 1, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    names = ["doc_id", "n_features", "n_words", "weight", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in chunks(batch.column(1)):
                bucket, at = features(data, offsets, longest, len(gain))
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                n = np.diff(at)
                weight = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1), 0)
                n_words = n if longest == 1 else np.diff(words(LOWER[data], offsets, NOT_ALNUM)[2])
                final = weight + np.array([noise(i, seed) for i in ids[first:end]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:end], pa.int64()), *(pa.array(x, pa.int64()) for x in (n, n_words, weight, final))], names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(score, ", ".join(f"{c} long" for c in names))


def _key(score: int, doc_id: int | None, row: int) -> tuple:
    return (-score, doc_id is None, doc_id or 0, row)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return [_key(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("score", "doc_id", "row")), strict=True)]


def splitters(runs: DataFrame, n: int, segments: int) -> list[tuple]:
    """segments - 1 keys that part the rows of sorted runs evenly: every run gives each stride-th key, at most segments ** 2 keys and one of each run in all.

    Between two splitters lie at most n / segments rows and one stride of each run.
    """
    stride = max(1, n // segments**2)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(-seen % stride, batch.num_rows, stride)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    taken = sorted(_key(*r) for r in runs.select("score", "doc_id", "row").mapInArrow(sample, "score long, doc_id long, row long").collect())
    return [taken[len(taken) * i // segments] for i in range(1, segments)] if len(taken) >= segments else taken[1:]


def ranked(runs: DataFrame, n: int, *, segment_rows: int = SEGMENT_ROWS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """runs (score, doc_id, row and more, n rows in sorted files) with rank: 1, 2, 3... by score downwards, then doc_id upwards, nulls last, then row.

    Rows go to the segment between their splitters, a segment's runs are merged by the window's sort, and the counts of the segments before it give its first rank.
    """
    segments = min(most_segments, max(1, -(-n // segment_rows)))
    split = splitters(runs, n, segments)
    place = unused(runs.columns, "segment")
    schema = StructType([*runs.schema.fields, StructField(place, IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [bisect.bisect_right(split, k) for k in _keys(batch)]
            yield batch.append_column(place, pa.array(to, pa.int32()))

    dealt = runs.mapInArrow(deal, schema)
    before = [0] * (len(split) + 1)
    for segment, count in dealt.groupBy(place).agg(F.count("*")).collect():
        before[segment] = count
    first = F.array(*(F.lit(int(x)) for x in np.concatenate([[0], np.cumsum(before[:-1])]))).cast("array<long>")
    local = F.row_number().over(Window.partitionBy(place).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return dealt.withColumn("rank", F.element_at(first, F.col(place) + 1) + local).drop(place)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, longest: int = 1, n_buckets: int = BUCKETS, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of those drawn: percent of the documents with least_words words or more, by score.

    Null and empty texts have no features and weight 0; a null id counts as empty text in its noise and comes last among ties. Repeated rows are rows
    of their own. An empty target counts no features; an empty table gives no rows. Names of other columns don't matter. Texts are never cut:
    one longer than a chunk is a chunk by itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = dict(longest=longest, n_buckets=n_buckets, text_column=text_column)
    gain = gains(bucket_counts(docs, **counted), bucket_counts(target, **counted))
    scores = weighted(docs, gain, longest=longest, seed=seed, id_column=id_column, text_column=text_column)
    scores = scores.withColumns({"row": F.monotonically_increasing_id(), "eligible": F.col("n_words") >= least_words}).drop("n_words")
    path = shared_dir(spark, "scored")  # sorted runs, apart by eligibility
    scores.sortWithinPartitions("eligible", F.desc("score"), F.asc_nulls_last("doc_id"), "row").write.partitionBy("eligible").parquet(path)
    runs = spark.read.schema(scores.schema).parquet(path)
    asked = runs.where("eligible").drop("eligible")
    n = asked.count()
    drawn = percent * n // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    rest = runs.where("NOT eligible").drop("eligible").withColumn("rank", F.lit(None).cast("long"))
    return ranked(asked, n, segment_rows=segment_rows).withColumn("rank", rank).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
