"""Packing by optimal length buckets (operator 2).

Texts longer than ``max_length`` tokens are cut into pieces of that length and a rest.  The histogram of piece
lengths over the whole corpus (at most max_length rows) goes to a dynamic program that chooses the bucket
boundaries with the least padding.  In each bucket pieces are numbered, and as many as the token budget holds at
the bucket's length form a batch.  Numbers are counted in shards and shifted by the counts of earlier shards, so
no task holds a bucket and each bucket has one batch that isn't full at most.

Defined results: null and empty texts have the end token alone (length 1); rows with one doc_id are packed each; a
null doc_id is packed like any; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored
from shelfspark.llm.tokens import token_counts

MAX_LENGTH, BUCKETS, BUDGET = 2048, 16, 65_536
SHARD_ROWS = 200_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least sum of padded lengths."""
    order = np.argsort(lengths)
    lengths, total = np.asarray(lengths, np.int64)[order], np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64)[order])])
    n = len(lengths)
    if not n:
        return []
    # cost[j] = least padded sum of the first j lengths; each bucket ends at length j - 1
    cost = np.concatenate([[0], lengths * total[1:]]).astype(np.float64)
    cost[0] = 0
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        # from i to j: lengths[j - 1] * (total[j] - total[i])
        best, arg = cost.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            way = cost[:j] + lengths[j - 1] * (total[j] - total[:j])
            i = int(np.argmin(way))
            if way[i] < best[j]:
                best[j], arg[j] = way[i], i
        back.append(arg)
        cost = best
    out, j = [], n
    for arg in reversed(back):
        if j == 0:
            break
        if arg[j] == j:
            continue  # no bucket was added here
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return sorted(out)


def pieces(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, piece, n_tokens; the end token counts."""
    counted = token_counts(docs, vocabulary_path, keys=(key,), text=text).select(F.col(key).alias("doc_id"), (F.col("n_tokens") + 1).alias("n"))
    whole = F.expr(f"int((n + {max_length - 1}) div {max_length})")
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(max_length), F.col("n") - F.col("piece") * max_length).cast("long").alias("n_tokens"))


def pack(lengths: DataFrame, *, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lengths: doc_id, piece, n_tokens (1 to max_length). Adds bucket, bucket_length, batch, slot."""
    if budget < max_length:
        raise ValueError("a batch must hold one piece of max_length")
    histogram = lengths.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()  # at most max_length rows
    sizes = np.array([r[0] for r in histogram], np.int64)
    counts = np.array([r[1] for r in histogram], np.int64)
    ends = boundaries(sizes, counts, buckets) or [max_length]
    shards = max(1, -(-int(counts.sum()) // shard_rows))
    rule = F
    for k, e in enumerate(ends):
        rule = rule.when(F.col("n_tokens") <= e, k)
    rows = lengths.withColumn("bucket", rule.cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))
    sums = rows.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = sums.select("bucket", "shard", F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens"))
    placed = rows.withColumn("own", own).join(before, ["bucket", "shard"])
    length = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1)
    rank, capacity = F.col("earlier") + F.col("own") - 1, F.lit(budget).cast("long")
    return placed.select("doc_id", "piece", "n_tokens", "bucket", length.cast("long").alias("bucket_length"), rank.alias("r"), F.floor(capacity / length).alias("fit")).select("doc_id", "piece", "n_tokens", "bucket", "bucket_length", F.expr("r div fit").alias("batch"), F.expr("r % fit").alias("slot"))


def pack_documents(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every piece of every document with its bucket, batch and place in the batch; texts are read once, and only lengths are shuffled."""
    lengths = stored(pieces(docs, vocabulary_path, key=key, text=text, max_length=max_length), "piece-lengths")
    return pack(lengths, max_length=max_length, buckets=buckets, budget=budget, shard_rows=shard_rows)
