"""Sync destinations: edits, stamps, the cache of their files, and what lies there now against what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import changes as C
from shelfspark.operators.catalogue import signature
from shelfspark.operators.effects import rescanned
from shelfspark.operators.hashing import TASK_BYTES, file_digests
from shelfspark.sources.shared import written
from shelfspark.sources.tree import listings, reachable

#: How many folders deep a destination is walked; a fixed value.
DEPTH = 12
#: Fields that an edit may set.
EDITABLE = ["name", "target_path", "profile_id"]


def edited(destinations: DataFrame, edits: DataFrame) -> DataFrame:
    """destinations with the last value that an edit gives each field (edits: id, seq, name, target_path, profile_id; a null leaves a field alone)."""
    given = F.map_filter(F.create_map(*(x for c in EDITABLE for x in (F.lit(c), F.col(c)))), lambda _, v: v.isNotNull())
    return C.changed(destinations, C.gathered(edits.select("id", "seq", given.alias("fields")), ["id"], "seq"), ["id"])


def deleted(destinations: DataFrame, inventory: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(destinations, inventory) without those of ids (id) and what is known of their files."""
    gone = ids.select("id").distinct()
    return destinations.join(gone, "id", "left_anti"), inventory.join(gone.withColumnRenamed("id", "dest_id"), "dest_id", "left_anti")


def stamped(destinations: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """destinations with value in a column (last_synced_at: a clock; signature: one, or null to clear it) of those of ids (id)."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    kind = destinations.schema[column].dataType
    return destinations.join(hit, "id", "left").withColumn(column, F.when(F.col("_hit"), value.cast(kind)).otherwise(F.col(column))).select(*destinations.columns)


def remembered(inventory: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """The next inventory after files were seen (seen: dest_id, rel_path, size_bytes, mtime, sha1, rom_id; one row a file): size and time are taken over, a null sha1 or rom_id keeps the old one."""
    fields = F.create_map(*(x for c in ("size_bytes", "mtime", "sha1", "rom_id") for x in (F.lit(c), F.col(c).cast("string"))))
    return C.changed(inventory, seen.select("dest_id", "rel_path", fields.alias("fields")), ["dest_id", "rel_path"], insert=True, keep_nulls=True, stamps={"last_seen_at": now})


def scan_destinations(destinations: DataFrame, inventory: DataFrame, *, max_depth: int = DEPTH, deep_verify: bool = False, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(the next inventory, the next destinations) after a walk of all destinations.

    destinations: id, target_path, signature; inventory: dest_id, rel_path, size_bytes, mtime, sha1, rom_id. One listing serves the signature, which
    comes first, and the rows: where it agrees (or there was none) files of the same size and time keep their sha1 and rom_id, elsewhere nothing is
    known any more. Absent files go. deep_verify reads and hashes every file anew (null where it can't be read). A destination that isn't
    there now keeps its rows and signature; an empty one has the signature "".
    """
    known = destinations.select(F.col("id").alias("dest_id"), F.col("target_path").alias("root"))
    there = written(reachable(known.select("root")), "reachable")
    seen = written(listings(there, max_depth=max_depth).join(known, "root"), "destination-files")
    up = known.join(there, "root", "left_semi").select("dest_id")
    signed = signature(seen.select("dest_id", "rel_path"), "dest_id", "rel_path")
    signatures = up.join(signed, "dest_id", "left").select("dest_id", F.coalesce("signature", F.lit("")).alias("signature"))
    columns = ["dest_id", "rel_path", "size_bytes", "mtime", "sha1", "rom_id"]
    now = rescanned(destinations, inventory, seen.select("dest_id", "rel_path", "size_bytes", "mtime"), signatures).select(*columns)
    if deep_verify:
        files = seen.select(F.col("path").alias("id"), "path", "size_bytes", F.lit(None).cast("string").alias("header_rule")).dropDuplicates(["id"])
        fresh = file_digests(files, task_bytes, raw=True).select(F.col("id").alias("path"), F.col("sha1").alias("_new"))
        fresh = seen.select("dest_id", "rel_path", "path").join(fresh, "path").select("dest_id", "rel_path", "_new")
        now = now.join(fresh, ["dest_id", "rel_path"], "left").withColumn("sha1", F.col("_new")).select(*columns)
    away = inventory.join(up, "dest_id", "left_anti").select(*columns)
    new = signatures.select(F.col("dest_id").alias("id"), F.col("signature").alias("_now"))
    return now.unionByName(away), destinations.join(new, "id", "left").withColumn("signature", F.coalesce("_now", "signature")).select(*destinations.columns)
