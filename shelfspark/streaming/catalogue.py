"""A catalogue that follows a stream of scanned files: ``foreachBatch`` and the merge that a full scan uses.

Each micro-batch gives the next snapshot, root/data/version=<batch>. A batch that runs again reads the snapshot before its own and
writes the same rows. A batch rewrites the catalogue, so batches should be large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfspark.operators import catalogue as C

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _columns(stream: DataFrame, order: str) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in stream.schema if f.name != order])


def snapshot(spark: SparkSession, root: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The newest snapshot, or the one that a batch found; without one, no rows."""
    path = f"{root.rstrip('/')}/data"
    try:
        every = spark.read.schema(StructType([*schema, StructField("version", LongType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        every = every.where(F.col("version") < before)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).select(*schema.names)


def follow(stream: DataFrame, root: str, *, order: str, key: str = "path", merge: Merge = C.upsert) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function that merges batches into the catalogue at root.

    Of several rows of a key in a batch the one with the greatest ``order`` counts (ties: the greatest row); rows with a null key go.
    """
    schema = _columns(stream, order)

    def step(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in schema.names if c != key]
        rows = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, *(f"r.{c}" for c in rest))
        old = snapshot(batch.sparkSession, root, schema, before=batch_id)
        merge(old, rows.select(*schema.names)).select(*schema.names).write.mode("overwrite").parquet(f"{root.rstrip('/')}/data/version={batch_id}")

    return step


def run_available(stream: DataFrame, root: str, *, order: str, key: str = "path", merge: Merge = C.upsert) -> DataFrame:
    """Takes in what the stream has now and returns the catalogue. Called again, it goes on from its checkpoint at root/checkpoint."""
    step = follow(stream, root, order=order, key=key, merge=merge)
    running = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return snapshot(stream.sparkSession, root, _columns(stream, order))
