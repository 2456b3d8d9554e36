"""Spark helpers of this subpackage."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"
ARROW_ROWS, ARROW_BYTES = "2000", str(8 << 20)
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes (a longer text is a batch by itself), so that long texts don't fill a worker's memory. The session keeps the setting, since plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); only a local session may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end (what is kept is a written table)."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors take nothing with them."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """Of all texts; only lengths are read and one number comes back."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: What a task reads where rows name work of a known size.
TASK_BYTES = 256 << 20


def tasks_for(spark: SparkSession, rows: int, total_bytes: float) -> int:
    """Partitions for rows that name work of total_bytes: as many as cores or as TASK_BYTES asks for, but none without a row."""
    return max(1, min(rows, max(spark.sparkContext.defaultParallelism, math.ceil(total_bytes / TASK_BYTES))))


def grouped_by(df: DataFrame, column: str, total_bytes: float) -> DataFrame:
    """df with at least one partition for TASK_BYTES before it is grouped by a column: dealt out by it where the session's number of partitions is too small, else as it is."""
    n = math.ceil(total_bytes / TASK_BYTES)
    return df.repartition(n, column) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def parts_of(total: float, part_bytes: int, least: int = 8) -> int:
    return max(least, math.ceil(total / part_bytes))


def shard_count(df: DataFrame, column: str, shard_bytes: int, least: int = 8) -> int:
    """How many shards of about shard_bytes the texts fill."""
    return parts_of(text_bytes(df, column), shard_bytes, least)


def unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
