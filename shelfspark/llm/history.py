"""A window index that lives between calls: new batches are deduplicated against all that came before them.

``substring_dedup`` judges a whole table in one job.  ``WindowHistory`` keeps what it has seen in immutable runs, one for each
batch: tables of window fingerprints (two 64-bit halves, the second verifies the first), dealt into a fixed number of buckets and
sorted in each, so a new batch is merge-joined with them and the runs aren't shuffled again.  A run holds only windows that
no earlier run has.  Runs of like size are merged, so there are about log2(batches) of them.

    history = WindowHistory(spark, "hdfs:///corpus/windows")
    history.add(monday)   # doc_id, n_words, n_removed, kept_sha256
    history.add(tuesday)  # windows that monday has are removed too

An index takes 16 bytes for each distinct window.  Shards of documents send each of their windows once, so a passage that every
document holds is one row for each shard.  The list of live runs is written after the runs themselves: a batch that failed leaves
nothing that later ones read, and can be added again; one that was taken in would lose all its windows to itself.  Batches are added
one at a time.  Merged runs stay under root/runs until someone deletes those that ``runs`` doesn't name.

Defined results: those of ``substring``, and a window of an earlier batch counts as one of a smaller doc_id, except for documents
without a doc_id, which are smaller than all others and lose nothing.  If ids rise from batch to batch, all batches together give
what one table of them gives.  An empty batch gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import substring
from shelfspark.llm.common import dropping_shuffles, shard_count, stored
from shelfspark.llm.repeats import SHARD_BYTES, Rule, _repeated, _state, _windows

_KEYS = ["a", "b"]
_SENT = "src int, n int, a long, b long, v long"


def _everything(state) -> np.ndarray:
    """No class is known yet and all of them ask."""
    return np.tile([False, True], (len(state.entries[0]), 1))


class WindowHistory:
    def __init__(self, spark: SparkSession, root: str, *, rule: Rule = substring.RULE, buckets: int = 64, shard_bytes: int = SHARD_BYTES):
        """buckets: how many parts a run has; the same for all of an index. A bucket is read as a stream and may be larger than memory."""
        if not rule.ordered:
            raise ValueError("the history keeps windows by their first document: rule.ordered")
        self.spark, self.root, self.rule, self.buckets, self.shard_bytes = spark, root.rstrip("/"), rule, buckets, shard_bytes

    # ---- the live runs

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.schema("place int").parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def runs(self) -> list[tuple[str, int]]:
        """Name and number of windows of each live run, the largest first."""
        path = f"{self.root}/live"
        if not self._exists(path):
            return []
        log = self.spark.read.schema("place int, run string, windows long, version int").option("basePath", path).parquet(path)
        last = log.agg(F.max("version")).first()[0]
        return [(r.run, r.windows) for r in log.where(F.col("version") == last).orderBy("place").collect()]  # about log2(batches) rows

    def _publish(self, runs: list[tuple[str, int]], version: int) -> None:
        rows = [(k, name, n) for k, (name, n) in enumerate(runs)]
        self.spark.createDataFrame(rows, "place int, run string, windows long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/live/version={version}")

    def _run(self, name: str) -> DataFrame:
        """A run as the bucketed table that it is; sessions that didn't write it are told of it."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (a BIGINT, b BIGINT) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{name}'")
        return self.spark.table(name)

    def _write(self, windows: DataFrame) -> tuple[str, int]:
        name = f"windows_{uuid.uuid4().hex}"
        with dropping_shuffles(self.spark):
            dealt = windows.select(*_KEYS).repartition(self.buckets, *_KEYS)
            dealt.write.format("parquet").bucketBy(self.buckets, *_KEYS).sortBy(*_KEYS).option("path", f"{self.root}/runs/{name}").saveAsTable(name)
        return name, self._run(name).count()

    # ---- batches

    def add(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The batch's rows as ``substring_dedup`` gives them; its windows are known from then on."""
        rule, runs, version = self.rule, self.runs(), self._version() + 1
        shards = shard_count(docs, text, self.shard_bytes)
        dealt = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shards)).cast("int").alias("__shard"))
        by_shard = dealt.groupBy("__shard")

        def send(table: pa.Table) -> pa.Table:
            src = table.column("__shard")[0].as_py()
            state = _state(table, rule, substring._read, src)
            a, b, v = _windows(state, rule, _everything(state)).keys
            n = len(a)
            return pa.table({"src": pa.array(np.full(n, src), pa.int32()), "n": pa.array(np.arange(n), pa.int32()), "a": a.view(np.int64), "b": b.view(np.int64), "v": v})

        sent = stored(by_shard.applyInArrow(send, _SENT), "windows-sent")
        first = sent.groupBy(*_KEYS).agg(F.min("v").alias("least"))
        old = F.lit(False)
        for k, (name, _) in enumerate(runs):
            first = first.join(self._run(name).withColumn(f"in{k}", F.lit(True)), _KEYS, "left")
            old = old | F.col(f"in{k}").isNotNull()
        first = stored(first.select(*_KEYS, "least", old.alias("old")), "windows-first")
        null_id = int(np.iinfo(np.int64).min)
        known = sent.join(first, _KEYS).where(F.when(F.col("old"), F.col("v") > null_id).otherwise(F.col("v") > F.col("least"))).select("src", "n")

        def last(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(table):
                return substring.digest_rows(table, [])
            state = _state(table, rule, substring._read, table.column("__shard")[0].as_py())

            def far(a: np.ndarray) -> np.ndarray:
                out = np.zeros(len(a), bool)
                out[answers.column("n").to_numpy()] = True
                return out

            return substring.digest_rows(table, _repeated(state, rule, _everything(state), far))

        out = stored(by_shard.cogroup(known.groupBy("src")).applyInArrow(last, substring.DIGEST), "windows-kept")
        fresh = self._write(first.where("NOT old"))
        if fresh[1]:
            self._publish(self._merged([*runs, fresh]), version)
        return out

    def _version(self) -> int:
        path = f"{self.root}/live"
        if not self._exists(path):
            return -1
        return self.spark.read.schema("place int, version int").option("basePath", path).parquet(path).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def _merged(self, runs: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Runs whose neighbour is less than twice as large are merged with it; runs have no window in common.."""
        while len(runs) > 1 and runs[-2][1] <= 2 * runs[-1][1]:
            *rest, (one, _), (two, _) = runs
            runs = [*rest, self._write(self._run(one).unionByName(self._run(two)))]
        return runs
