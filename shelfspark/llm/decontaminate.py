"""Benchmark decontamination by winnowing (operator 5).

Words of documents and items are fingerprinted; of the K-word grams in each WINDOW-word window the least one is
kept, so any shared run of WINDOW words keeps the same gram on both sides (K + width - 1 = WINDOW).  Documents'
kept grams are joined with the items' ones; at each hit the windows that kept that gram are compared with the
items' windows (the extension), which covers every longer run window by window.  An item of fewer words is one
window of its own length; those are looked up at every position.

The index of the items is sent to the executors only while the benchmark has at most ``most_bytes`` bytes of
text (measured first); larger benchmarks are joined by shuffles with the same result.

Defined results: null text has no words and is clean; an item without words never occurs; equal item ids count
once, and null item ids as one item 'None'; repeated rows are judged each; an empty benchmark hits nothing; extra columns are ignored by
``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import LOWER, NOT_ALNUM, chunks, column_bytes, covered, mix, ngrams, per_document, sliding_min, valid_starts, word_hashes, words
from shelfspark.llm.common import bounded_batches, stored, unused

WINDOW, K = 13, 5
MOST_BYTES = 16 << 20


def _doc_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    s, e, at = words(low, offsets, NOT_ALNUM)
    return word_hashes(low, s, e), at


def winnow(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of the gram that each window keeps, all grams)"""
    grams = ngrams(h, K)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    order = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(order, WINDOW - K + 1)
    starts = np.flatnonzero(valid_starts(at, WINDOW, len(least)))
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), grams


class BenchmarkIndex:
    """Sorted fingerprints and windows of the items, with the items of each window."""

    def __init__(self, ids: list, texts: list):
        data, offsets = column_bytes(pa.array(texts, pa.string()))
        self.words, at = _doc_words(data, offsets)
        self.ids = [str(i) for i in ids]
        starts, kept, grams = winnow(self.words, at)
        self.prints = np.unique(grams[kept]) if len(kept) else np.zeros(0, np.uint64)
        self.windows = {}
        sizes = np.diff(at)
        whole = ngrams(self.words, WINDOW)
        if len(starts):
            self.windows[WINDOW] = self._group(whole[starts], starts, np.searchsorted(at, starts, "right") - 1)
        for n in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]).tolist():
            items = np.flatnonzero(sizes == n)
            self.windows[n] = self._group(ngrams(self.words, n)[at[items]], at[items], items)

    @staticmethod
    def _group(key, place, item):
        order = np.argsort(key, kind="stable")
        unique, first = np.unique(key[order], return_index=True)
        return unique, place[order][first], np.append(first, len(key)), item[order]

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, window number within its length) of every window that occurs in an item."""
        out = []
        for n, (keys, place, _, _) in self.windows.items():
            if len(h) < n:
                continue
            if n == WINDOW:
                starts, kept, grams = winnow(h, at)
                seen = np.zeros(len(grams), bool)
                own = np.unique(kept)
                seen[own] = np.isin(grams[own], self.prints)
                starts = starts[seen[kept]]
            else:
                starts = np.flatnonzero(valid_starts(at, n, len(h) - n + 1))
            if not len(starts):
                continue
            got = ngrams(h, n)[starts]
            k = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            same = keys[k] == got
            starts, k = starts[same], k[same]
            span = np.arange(n)
            true = (h[starts[:, None] + span] == self.words[place[k][:, None] + span]).all(1)  # word by word
            out.append((starts[true], np.full(int(true.sum()), n), k[true]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """n_words, n_hit and the item ids of each document."""
        h, at = _doc_words(data, offsets)
        start, length, window = self.hits(h, at)
        n_hit = per_document(covered(start, start + length, len(h)), at)
        items: list[list[str]] = [[] for _ in range(len(at) - 1)]
        doc = np.searchsorted(at, start, "right") - 1
        for d in np.unique(doc).tolist():
            mine = doc == d
            found = set()
            for n, k in {*zip(length[mine].tolist(), window[mine].tolist(), strict=True)}:
                _, _, bounds, item = self.windows[n]
                found.update(self.ids[i] for i in item[bounds[k] : bounds[k + 1]].tolist())
            items[d] = sorted(found)
        return np.diff(at), n_hit, items


def _item_id(item: str):
    return F.coalesce(F.col(item).cast("string"), F.lit("None")).alias("id")


def _index(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> BenchmarkIndex | None:
    total = benchmark.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    if (total[0] or 0) + 16 * total[1] > most_bytes:
        return None
    rows = benchmark.select(_item_id(item), text).collect()  # at most most_bytes
    return BenchmarkIndex([r[0] for r in rows], [r[1] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    bounded_batches(docs.sparkSession)
    index = _index(benchmark, item, item_text, most_bytes)
    if index is None:
        # a row gets a number, so that equal ids stay apart
        numbered = stored(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("k"), F.col(text).alias("t")), "numbered")
        return _joined(numbered, benchmark, item, item_text).select(F.col("k").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                n, hit, items = index.judge(data, offsets)
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array((hit > 0) & (20 * hit >= n))], names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; map only while the index is small."""
    bounded_batches(docs.sparkSession)
    index = _index(benchmark, item, item_text, most_bytes)
    if index is None:
        row = unused(docs.columns, "__row")
        gone = unused([*docs.columns, row], "__bad")
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        numbered = rows.select(F.col(row).alias("id"), F.col(key).alias("k"), F.col(text).alias("t"))
        bad = _joined(numbered, benchmark, item, item_text).where("contaminated").select(F.col("id").alias(gone))
        return rows.join(bad, F.col(row) == F.col(gone), "left_anti").select(*docs.columns)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, data, offsets in chunks(batch.column(place)):
                n, hit, _ = index.judge(data, offsets)
                keep.append(~((hit > 0) & (20 * hit >= n)))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)


def _short(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Starts of n consecutive words of one text."""
    return np.flatnonzero(valid_starts(at, n, size - n + 1)) if size >= n else np.zeros(0, np.int64)


def _item_windows(batches):
    """Rows (id, n, gram, w1, w2) of each window of the items; gram: the one that it keeps, of a short item's window its own hash."""
    for batch in batches:
        for a, _, data, offsets in chunks(batch.column(1)):
            h, at = _doc_words(data, offsets)
            size = np.diff(at)
            starts, kept, grams = winnow(h, at)
            parts = [(starts, grams[kept], WINDOW)]
            for n in range(1, WINDOW):
                s = _short(at, len(h), n)
                s = s[size[np.searchsorted(at, s, "right") - 1] == n]
                parts.append((s, ngrams(h, n)[s], n))
            for s, gram, n in parts:
                if len(s):
                    doc = np.searchsorted(at, s, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array(np.full(len(s), n), pa.int32()), *(pa.array(x.view(np.int64)) for x in (gram, ngrams(h, n)[s], ngrams(h, n, 991)[s]))], names=["id", "n", "gram", "w1", "w2"])


def _prints(batches, lengths: list[int]):
    """Rows (id, n, gram): the grams that a document's windows keep, and its short windows of these lengths; each once a document."""
    for batch in batches:
        for a, _, data, offsets in chunks(batch.column(1)):
            h, at = _doc_words(data, offsets)
            starts, kept, grams = winnow(h, at)
            parts = [(starts, grams[kept], WINDOW)] + [(s, ngrams(h, n)[s], n) for n in lengths for s in [_short(at, len(h), n)]]
            for s, gram, n in parts:
                doc = np.searchsorted(at, s, "right") - 1
                order = np.lexsort((gram, doc))
                doc, gram = doc[order], gram[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc[new])), pa.array(np.full(int(new.sum()), n), pa.int32()), pa.array(gram[new].view(np.int64))], names=["id", "n", "gram"])


def _candidates(batches):
    """Rows (id, start, n, w1, w2) of the windows that keep one of the grams that their document shares with an item (columns id, t, ns, grams)."""
    for batch in batches:
        ns, gs = batch.column(2), batch.column(3)
        for a, b, data, offsets in chunks(batch.column(1)):
            h, at = _doc_words(data, offsets)
            own_n, own_g = (x.slice(a, b - a) for x in (ns, gs))
            owner = np.repeat(np.arange(b - a), np.diff(own_n.offsets.to_numpy()))
            flat_n, flat_g = own_n.flatten().to_numpy(), own_g.flatten().to_numpy().view(np.uint64)
            starts, kept, grams = winnow(h, at)
            for n in np.unique(flat_n).tolist():
                s = starts if n == WINDOW else _short(at, len(h), n)
                gram = grams[kept] if n == WINDOW else ngrams(h, n)[s]
                doc = np.searchsorted(at, s, "right") - 1
                mine = flat_n == n
                pair = lambda d, g: mix(g + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                s = s[np.isin(pair(doc, gram), pair(owner[mine], flat_g[mine]))]  # a chance equality is found out by the join that follows
                doc = np.searchsorted(at, s, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array(s - at[doc], pa.int64()), pa.array(np.full(len(s), n), pa.int32()), *(pa.array(x.view(np.int64)) for x in (ngrams(h, n)[s], ngrams(h, n, 991)[s]))], names=["id", "start", "n", "w1", "w2"])


def _joined(numbered: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """The same result by shuffled joins, for stored rows with a number (id), a key (k) and a text (t).

    Documents send the distinct grams that they keep; those that an item keeps come back to their documents, and only the windows around them are extended.
    """
    items = benchmark.select(_item_id(item), F.col(item_text).alias("t"))
    tests = stored(items.mapInArrow(_item_windows, "id string, n int, gram long, w1 long, w2 long"), "benchmark-windows")
    lengths = sorted(r["n"] for r in tests.where(f"n < {WINDOW}").select("n").distinct().collect())  # at most 12
    prints = numbered.select("id", "t").mapInArrow(lambda it: _prints(it, lengths), "id long, n int, gram long")
    near = prints.join(tests.select("n", "gram").distinct(), ["n", "gram"], "left_semi")
    shared = stored(near.groupBy("id").agg(F.collect_list(F.struct("n", "gram")).alias("p")).select("id", F.col("p.n").alias("ns"), F.col("p.gram").alias("grams")), "shared-grams")
    windows = numbered.select("id", "t").join(shared, "id").select("id", "t", "ns", "grams").mapInArrow(_candidates, "id long, start long, n int, w1 long, w2 long")
    hit = stored(windows.join(tests.select("n", "w1", "w2", F.col("id").alias("item")).distinct(), ["n", "w1", "w2"]).select("id", "start", "n", "item"), "window-hits")
    found = hit.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spots = hit.select("id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("id").agg(F.count("*").alias("n_hit"))

    def sizes(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                at = _doc_words(data, offsets)[1]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(np.diff(at), pa.int64())], names=["id", "k", "n_words"])

    kind = numbered.schema["k"].dataType.simpleString()
    counted = numbered.mapInArrow(sizes, f"id long, k {kind}, n_words long")
    joined = counted.join(found, "id", "left").join(spots, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("id", "k", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
