"""Counts that summaries and previews show, each as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _bytes(condition: Column, size: str = "size_bytes") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(size))), F.lit(0))


def system_counts(items: DataFrame, systems: DataFrame) -> DataFrame:
    """system_id, display_name, n of the systems that have items; listed by display name. systems: id, display_name."""
    n = items.groupBy("system_id").agg(F.count("*").alias("n"))
    return n.join(systems.select(F.col("id").alias("system_id"), "display_name"), "system_id")


def cover_counts(covers: DataFrame) -> DataFrame:
    return covers.groupBy("rom_id", "cover_type").agg(F.count("*").alias("n"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """kind, n_actions, n_bytes of a plan (kind, size_bytes)."""
    return plan.groupBy("kind").agg(F.count("*").alias("n_actions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def is_destructive(plan: DataFrame, kinds: tuple[str, ...] = ("delete_dest", "delete_local")) -> DataFrame:
    """One row: whether the plan deletes anything."""
    return plan.agg(F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False)).alias("is_destructive"))


def export_folders(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """system_id, folder, n_files, n_bytes of what an export writes, and unsupported for systems that it can't take (folder null); files of a folder are in ``export_files``."""
    m = mappings.where("supported AND folder <> ''").select("system_id", "folder")
    j = items.select("system_id", "size_bytes").join(m, "system_id", "left")
    return j.groupBy("system_id", "folder").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes")).withColumn("unsupported", F.col("folder").isNull())


def export_files(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """folder, filename of each file of an export, a row each: a folder has no bound."""
    m = mappings.where("supported AND folder <> ''").select("system_id", "folder")
    return items.select("system_id", "filename").join(m, "system_id").select("folder", "filename")


def export_counts(rows: DataFrame) -> DataFrame:
    """The eight counters of each system. rows: system_id, size_bytes, outcome (copied, unsupported, already_present, refused, error, artwork or duplicate)."""
    o = F.col("outcome")
    named = {"skipped_unsupported": "unsupported", "skipped_already_present": "already_present", "skipped_refused": "refused", "errors": "error", "artwork_copied": "artwork", "skipped_duplicates": "duplicate"}
    return rows.groupBy("system_id").agg(_count(o == "copied").alias("copied"), _bytes(o == "copied").alias("bytes_copied"), *(_count(o == v).alias(k) for k, v in named.items()))


def sync_counts(rows: DataFrame) -> DataFrame:
    """The seven counters of each system. rows: system_id, kind, size_bytes, failed."""
    done = lambda kind: (F.col("kind") == kind) & ~F.col("failed")
    copied = done("copy_to_dest") | done("copy_to_local")
    named = {"copied_to_dest": "copy_to_dest", "copied_to_local": "copy_to_local", "deleted_dest": "delete_dest", "deleted_local": "delete_local", "skipped_identical": "identical"}
    return rows.groupBy("system_id").agg(*(_count(done(v)).alias(k) for k, v in named.items()), _count(F.col("failed")).alias("failed"), _bytes(copied).alias("bytes_copied"))


def import_summary(plan: DataFrame, folders: DataFrame) -> DataFrame:
    """One row: files, one count for each status, bytes of what isn't skipped, and the systems that get a folder, in order.

    plan: system_id, status, resolution, size_bytes; folders: system_id of those that have a folder.
    """
    s = F.col("status")
    known = folders.select("system_id", F.lit(True).alias("_known")).distinct()
    fresh = F.when(F.col("_known").isNull(), F.col("system_id"))
    statuses = ["new", "dupe_path", "dupe_filename", "dupe_hash", "multi_rom_archive"]
    created = F.sort_array(F.collect_set(fresh)).alias("created_systems")  # at most as many as there are systems
    return plan.join(known, "system_id", "left").agg(F.count("*").alias("n_files"), *(_count(s == x).alias(f"n_{x}") for x in statuses), _bytes(F.col("resolution") != "skip").alias("n_bytes"), created)


def sync_preview(plan: DataFrame) -> DataFrame:
    """One row: count and bytes of each bucket of a sync plan."""
    kinds = ["copy_to_dest", "copy_to_local", "delete_dest", "conflict", "identical"]
    return plan.agg(*(x for k in kinds for x in (_count(F.col("kind") == k).alias(f"n_{k}"), _bytes(F.col("kind") == k).alias(f"bytes_{k}"))))


def folder_counts(items: DataFrame) -> DataFrame:
    """system_id, folder (in small letters), n of the items that lie in each folder."""
    return items.groupBy("system_id", F.lower(N.parent(F.col("path"))).alias("folder")).agg(F.count("*").alias("n"))


def content_groups(items: DataFrame) -> DataFrame:
    """sha1, n_files, n_bytes of every content that several items have."""
    own = items.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))
    return own.where("n_files > 1")


def distinct_crcs(dimensions: DataFrame) -> DataFrame:
    """system_id, n_crcs over all dimensions (system_id, dimension, crc)."""
    return dimensions.select("system_id", "crc").distinct().groupBy("system_id").agg(F.count("*").alias("n_crcs"))


def unmapped_platforms(entries: DataFrame, platforms: DataFrame) -> DataFrame:
    """platform of entries that no known platform has."""
    return entries.select("platform").where("platform IS NOT NULL").distinct().join(platforms.select("platform"), "platform", "left_anti")


def enrichment_stats(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_processed, n_metadata, n_covers. candidates: id; found: id, has_metadata, n_covers of those that a provider knew."""
    j = candidates.select("id").join(found, "id", "left")
    return j.agg(F.count("*").alias("n_processed"), _count(F.col("has_metadata")).alias("n_metadata"), F.coalesce(F.sum("n_covers"), F.lit(0)).alias("n_covers"))
