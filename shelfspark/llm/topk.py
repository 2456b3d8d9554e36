"""Exact top-k search by inner product: postings of the candidates, scattered term after term into dense score arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded_batches, stored

#: A block holds so many rows, or fewer where their components are more than so many.
BLOCK_ROWS, BLOCK_COMPONENTS = 8192, 1 << 20
QUERY_ROWS, QUERY_COMPONENTS = 2048, 1 << 18
_LONG = (-(1 << 63), (1 << 63) - 1)


def weights(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every component that isn't zero after scaling and rounding down; a weight is an integer in a double."""
    sizes = np.diff(vectors.offsets.to_numpy())
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = np.flatnonzero(x)
    return row[there], term[there], x[there]


class Postings:
    """Rows and weights of each term of a block. Scores are 64-bit integers if the largest possible one fits, else Python integers cut to a long at the end."""

    def __init__(self, vectors: pa.ListArray, scale: int, most: float):
        row, term, w = weights(vectors, scale)
        self.size = len(vectors)
        order = np.argsort(term, kind="stable")
        self.row, self.terms = row[order], term[order]
        largest = float(np.abs(w).max(initial=0.0))
        self.exact = largest * max(most, 1.0) < 2.0**62
        self.weight = w[order].astype(np.int64) if self.exact else np.array([int(v) for v in w[order]], object)

    def scores(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64 if self.exact else object)
        first, last = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        for a, b, v in zip(first, last, values.tolist(), strict=True):
            part = self.weight[a:b] * int(v)
            if b - a == self.size:  # every row has this term
                out += part
            elif b > a:  # a term has a row once, so nothing is added twice
                out[self.row[a:b]] += part
        return out if self.exact else np.array([min(max(s, _LONG[0]), _LONG[1]) for s in out], np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the highest scores, ties to the first rows; in no order."""
    n = len(scores)
    if n <= k:
        return np.arange(n)
    least = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _search(k: int, scale: int, schema: pa.Schema):
    def of_blocks(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return schema.empty_table()
        candidates = candidates.select(["vec_id", "row", "v"]).sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        rows, ids = candidates["row"].to_numpy(), candidates["vec_id"].to_numpy()
        place = {int(r): i for i, r in enumerate(rows)}
        q = queries.combine_chunks()
        at, term, w = weights(_array(q["v"]), scale)
        most = float(np.bincount(at, np.abs(w), minlength=len(q)).max(initial=0.0))  # sum of absolute weights of the heaviest query
        postings = Postings(_array(candidates["v"]), scale, most)
        cut = np.searchsorted(at, np.arange(len(q) + 1))
        parts: list[tuple[np.ndarray, ...]] = []
        for i, (row, vec_id) in enumerate(zip(q["row"].to_pylist(), q["vec_id"].to_pylist(), strict=True)):
            scores = postings.scores(term[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]])
            own = place.get(row)
            top = best(scores, k + (own is not None))
            top = top[top != own] if own is not None else top
            if own is not None and len(top) > k:  # the query's own row isn't among them
                top = top[np.lexsort((top, -scores[top].astype(object)))[:k]]
            parts.append((np.full(len(top), row), np.full(len(top), vec_id), ids[top], rows[top], scores[top]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=schema)

    return of_blocks


def _array(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0)


def _blocks(rows: int, components: int, block_rows: int, block_components: int) -> int:
    return max(1, -(-rows // block_rows), -(-components // block_components))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row for which is_query holds; candidates are all rows but the query's own.

    Components are scaled and rounded down; the score is the integer inner product (beyond a long: its limit), ties go to the smaller id.
    Every block of queries meets every block of candidates in one group, a bounded one; a shuffle merges the blocks' k best.
    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors may differ in length: what a shorter
    one lacks counts as zero, and an empty one scores zero. Repeated ids are rows of their own: each asks, and each may be an answer.
    Names of other columns don't matter. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    one = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    own = stored(one.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = F.sum(F.size("v"))
    n, components, n_q, q_components = own.agg(F.count("*"), size, F.count_if("asks"), F.sum(F.when(F.col("asks"), F.size("v")))).first()
    n_c, n_b = _blocks(n, components or 0, block_rows, BLOCK_COMPONENTS), _blocks(n_q, q_components or 0, query_rows, QUERY_COMPONENTS)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    v = F.col("v").cast("array<double>").alias("v")
    candidates = own.select("row", "vec_id", v, F.pmod(F.xxhash64("row"), F.lit(n_c)).cast("int").alias("c"), each(n_b).alias("b"))
    queries = own.where("asks").select("row", "vec_id", v, F.pmod(F.xxhash64("row"), F.lit(n_b)).cast("int").alias("b"), each(n_c).alias("c"))
    names = ["query", "query_id", "vec_id", "row", "score"]
    search = _search(k, scale, pa.schema([(c, pa.int64()) for c in names]))
    found = candidates.groupBy("b", "c").cogroup(queries.groupBy("b", "c")).applyInArrow(search, ", ".join(f"{c} long" for c in names))
    place = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
