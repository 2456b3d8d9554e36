"""Imports: what is staged and what becomes of it, as rows; the catalogue after a plan was carried out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.catalogue import import_status, upsert
from shelfspark.operators.hashing import TASK_BYTES, file_digests, several_inside
from shelfspark.operators.resolve import first_wins
from shelfspark.operators.systems import known_extensions
from shelfspark.plans.organize import unique_names
from shelfspark.sources import tree as T
from shelfspark.sources.shared import written

#: Folder of files without a system; a fixed value.
UNSORTED = "_unsorted"


def takes(extension: Column, extensions: Column) -> Column:
    """Whether a system with these extensions takes a file: archives always, others if theirs is among them."""
    return extension.isin(N.ARCHIVES) | F.coalesce(F.array_contains(F.transform(extensions, F.lower), extension), F.lit(False))


def staged_systems(staging: DataFrame, systems: DataFrame) -> DataFrame:
    """staging without side files, with system_id and confidence: the nearest folder's system if it takes the file, else the only system that has its extension.

    staging: rel_path, filename; systems: id, ord, folder_aliases, extensions.
    """
    own = staging.withColumn("_ext", N.extension(F.col("filename"))).where(~F.col("_ext").isin(N.SIDE_EXTENSIONS))
    by_folder = T.resolve_systems(own, T.alias_table(systems)).join(systems.select(F.col("id").alias("system_id"), F.col("extensions").alias("_known")), "system_id", "left")
    by_extension = T.extension_table(systems).select(F.col("extension").alias("_ext"), F.col("system_id").alias("_only"))
    system = F.coalesce(F.when(takes(F.col("_ext"), F.col("_known")), F.col("system_id")), "_only")
    out = by_folder.join(by_extension, "_ext", "left").withColumn("system_id", system)
    return out.select(*staging.columns, "system_id", F.when(F.col("system_id").isNull(), "unmatched").otherwise("fuzzy").alias("confidence"))


def _below(path: str, root: str) -> bool:
    path, root = os.path.abspath(path), os.path.abspath(root)
    return path == root or path.startswith(root.rstrip("/") + "/")


def import_plan(staging: DataFrame, library: DataFrame, systems: DataFrame, catalogue: DataFrame, *, staging_root: str, library_root: str, by_content: bool = False, default: str = "copy", task_bytes: int = TASK_BYTES) -> DataFrame:
    """source_path, target_path, system_id, confidence, size_bytes, mtime, status, resolution, collides_with, new_folder of each staged file but side files.

    staging and library: listings (path, rel_path, filename, size_bytes, mtime); systems: id, ord, folder_aliases, extensions, header_rule;
    catalogue: id, path, sha1. A file goes to its system's first alias, or to the folder of unsorted ones; new_folder: the library has no
    file below that folder yet. Paths decide first. Only with by_content, and only for what they leave as new and a system takes,
    are contents read; one that the catalogue has is a dupe_hash, and is known by its content. An archive of several games
    is told by its directory, which is all that is read of it, before anything else.
    """
    if _below(staging_root, library_root):
        raise ValueError("the staging folder must be outside the library")
    folders = systems.select(F.col("id").alias("system_id"), F.get("folder_aliases", F.lit(0)).alias("_alias"), "header_rule", F.col("extensions").alias("_known"))
    rows = staged_systems(staging, systems).join(folders, "system_id", "left")
    folder = F.when(F.col("system_id").isNull(), UNSORTED).otherwise(F.coalesce("_alias", "system_id"))
    rows = rows.withColumn("_folder", folder)
    rows = rows.withColumn("target_path", F.concat_ws("/", F.lit(library_root.rstrip("/")), "_folder", "filename")).withColumn("id", F.col("path"))
    there = library.where(F.contains("rel_path", F.lit("/"))).select(F.substring_index("rel_path", "/", 1).alias("_folder"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "_folder", "left").withColumn("new_folder", F.col("_there").isNull() & F.col("system_id").isNotNull())
    extensions = [r[0] for r in known_extensions(systems).collect()]  # of the registry of systems, which every task needs whole
    rows = written(rows.select("id", "filename", "target_path", "system_id", "confidence", "size_bytes", "mtime", "header_rule", "_known", "new_folder"), "staged")
    multi = several_inside(rows.select("id", F.col("id").alias("path")), extensions, task_bytes).withColumn("is_multi", F.lit(True))
    marked = rows.join(multi, "id", "left").withColumn("is_multi", F.coalesce("is_multi", F.lit(False))).withColumn("sha1", F.lit(None).cast("string"))
    first = written(import_status(marked, catalogue, library, by_content=False, default=default), "by-path")
    out = first
    if by_content:
        ext = N.extension(F.col("filename"))
        asked = first.where("status = 'new' AND system_id IS NOT NULL").where((F.size("_known") == 0) | takes(ext, F.col("_known")))
        digests = file_digests(asked.select("id", F.col("id").alias("path"), "size_bytes", "header_rule"), task_bytes).where("sha1 IS NOT NULL")
        known = first_wins(catalogue.select(F.lower("sha1").alias("sha1"), F.col("id").alias("_same")), ["sha1"], [F.col("_same")])
        hits = digests.select("id", "sha1").join(known, "sha1").select("id", "_same")
        same = F.col("_same").isNotNull()
        out = first.join(hits, "id", "left").withColumns(
            {
                "status": F.when(same, "dupe_hash").otherwise(F.col("status")),
                "resolution": F.when(same, "skip").otherwise(F.col("resolution")),
                "collides_with": F.coalesce("_same", "collides_with"),
                "confidence": F.when(same & (F.col("confidence") == "fuzzy"), "dat_verified").otherwise(F.col("confidence")),
            }
        )
    return out.select(F.col("id").alias("source_path"), "target_path", "system_id", "confidence", "size_bytes", "mtime", "status", "resolution", "collides_with", "new_folder")


def placed(plan: DataFrame, items: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of a plan that aren't skipped, with the path that each one's file gets.

    keep_both gets the next free name beside its target: free of files, catalogue rows and other targets.
    plan: id, target_path, resolution; items and disk: path.
    """
    done = plan.where("resolution <> 'skip'")
    direct = done.where("resolution <> 'keep_both'").withColumn("path", F.col("target_path"))
    both = done.where("resolution = 'keep_both'")
    taken = items.select(F.col("path").alias("name")).unionByName(disk.select(F.col("path").alias("name"))).unionByName(direct.select(F.col("path").alias("name")))
    free = unique_names(both.select("id", F.col("target_path").alias("name")), taken).select("id", F.col("free_name").alias("path"))
    return direct.unionByName(both.join(free, "id").select(*direct.columns))


def landed(plan: DataFrame, items: DataFrame, disk: DataFrame) -> DataFrame:
    """Files that are on disk after a plan, and whether the staged one is gone (moved). Of several rows with one path the last id's file is there in the end."""
    return first_wins(placed(plan, items, disk), ["path"], [-F.col("id")]).withColumn("moved", F.col("resolution") == "move")


def imported(items: DataFrame, plan: DataFrame, disk: DataFrame, library_root: str) -> DataFrame:
    """The next catalogue after an import: files of a system are merged by path with what their names say, of several the last id's; files without one lie on disk only.

    plan: id, target_path, size_bytes, mtime, system_id, confidence, resolution (copy, move, replace, keep_both, skip). New rows have no id.
    """
    files = first_wins(placed(plan, items, disk).where("system_id IS NOT NULL"), ["path"], [-F.col("id")])
    name = N.base_name(F.col("path"))
    f = N.parsed(name)
    shown = lambda c: F.nullif(c, F.lit(""))
    new = files.select(
        "path", name.alias("filename"), *(f[c].alias(c) for c in ("extension", "region", "revision", "is_hack", "is_homebrew", "fuzzy_key")), "size_bytes", "mtime", "system_id",
        F.coalesce(shown(f["display_title"]), shown(f["clean_name"]), name).alias("title"), F.coalesce("confidence", F.lit("fuzzy")).alias("match_confidence"), F.lit(library_root).alias("library_root"),
    )
    return upsert(items, new)
