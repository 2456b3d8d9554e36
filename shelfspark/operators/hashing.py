"""Digests of files that a catalogue lists: which ones need them, read in tasks of even bytes, merged into the table of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.catalogue import replace_rows
from shelfspark.operators.lookups import to_hash, with_hashes
from shelfspark.sources import contents
from shelfspark.sources.shared import written

TASK_BYTES = 256 << 20


def dealt(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """files (path, size_bytes) in ceil(bytes / task_bytes) partitions of about as many bytes.

    Files are ranged by size, largest first, and each range deals its own to all partitions in turn, so no partition gets more
    than the others by more than a file of each range.
    """
    total, n = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(n, -(-int(total) // task_bytes)))
    spark = files.sparkSession
    parts = max(parts, min(n, spark.sparkContext.defaultParallelism))
    order = [F.desc_nulls_last("size_bytes"), F.col("path")]
    ranged = files.repartitionByRange(max(1, parts // 16), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    to = F.pmod((place % F.lit(1 << 33)) + F.shiftright(place, 33) * 7, F.lit(parts)).cast("int")
    return ranged.withColumn("_to", to).repartitionById(parts, "_to").drop("_to")


def file_digests(files: DataFrame, task_bytes: int = TASK_BYTES, *, raw: bool = False) -> DataFrame:
    """id, crc32, sha1, md5, size of each file's content by its header rule; nulls where it can't be read. files: id, path, size_bytes, header_rule; raw: of the bytes as they are."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rules = batch.column("path").to_pylist(), batch.column("header_rule").to_pylist()
            found = [(contents.digests_of(p, r, raw=raw) if p is not None else None) or (None,) * 4 for p, r in zip(paths, rules, strict=True)]
            crc32, sha1, md5, size = ([f[k] for f in found] for k in range(4))
            text = [pa.array(c, pa.string()) for c in (crc32, sha1, md5)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *text, pa.array(size, pa.int64())], ["id", "crc32", "sha1", "md5", "size"])

    rows = files.select("id", "path", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("header_rule").cast("string").alias("header_rule"))
    kind = rows.schema["id"].dataType.simpleString()
    return dealt(rows, task_bytes).mapInArrow(digest, f"id {kind}, crc32 string, sha1 string, md5 string, size long")


def several_inside(files: DataFrame, extensions: list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """id of each .zip that has more than one file with a known extension; only archives' directories are read. files: id, path."""
    known = {e.lower() for e in extensions}

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (sum("." + n.rpartition("/")[2].rpartition(".")[2].lower() in known for n in contents.archived_names(p) if "." in n.rpartition("/")[2][1:]) for p in batch.column("path").to_pylist())
            yield batch.select(["id"]).filter(pa.array([c > 1 for c in counts], pa.bool_()))

    zips = files.select("id", "path", F.lit(1 << 16).cast("long").alias("size_bytes")).where(F.lower("path").endswith(".zip"))
    return dealt(zips, task_bytes).mapInArrow(several, f"id {zips.schema['id'].dataType.simpleString()}")


def hash_library(items: DataFrame, systems: DataFrame, hashes: DataFrame, now: Column, *, ids: DataFrame | None = None, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(the next hashes, id of each file that couldn't be read): items without a hash, or with one older than the file, are read and hashed.

    items: id, path, size_bytes, mtime, system_id; systems: id, header_rule; hashes: rom_id, crc32, sha1, md5, hashed_at; ids: only
    these. A file that can't be read keeps the hash it had.
    """
    asked = to_hash(with_hashes(items, systems, hashes), ids)
    found = written(file_digests(asked.select("id", "path", "size_bytes", "header_rule"), task_bytes), "digests")
    new = found.where("sha1 IS NOT NULL").select(F.col("id").alias("rom_id"), "crc32", "sha1", "md5", now.cast(hashes.schema["hashed_at"].dataType).alias("hashed_at"))
    return replace_rows(hashes.select(*new.columns), new, ["rom_id"]), found.where("sha1 IS NULL").select("id")
