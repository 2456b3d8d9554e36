"""What applied plans make of a snapshot: functions from snapshots to snapshots; files themselves are moved elsewhere.

All actions of a plan are judged against the snapshot that it is applied to, so their outcome doesn't depend on an order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.catalogue import insert_ignore, replace_rows
from shelfspark.operators.resolve import first_wins, preferred_first


def organize_outcome(items: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with outcome: applied, failed or skipped (collisions).

    A duplicate is only deleted if its content still equals that of the file it duplicates (items: id, path, sha1); a rename needs a path that nothing
    keeps once these deletions are done; a folder merge needs that no file of the folder meets one of its name.
    """
    at = items.select("id", "path", F.lower("sha1").alias("sha1"))
    source = at.select(F.col("id").alias("rom_id"), F.col("sha1").alias("_sha"))
    target = at.select(F.col("path").alias("target_path"), F.col("id").alias("_there"), F.col("sha1").alias("_target_sha"))
    known = plan.join(source, "rom_id", "left").join(target.dropDuplicates(["target_path"]), "target_path", "left")
    same = F.col("_there").isNull() | F.coalesce(F.col("_sha") == F.col("_target_sha"), F.lit(False))
    gone = known.where((F.col("kind") == "delete_file") | ((F.col("kind") == "delete_duplicate") & same)).select(F.col("rom_id").alias("id"))
    stays = target.join(gone.select(F.col("id").alias("_there")).distinct(), "_there", "left_anti").select("target_path", F.lit(True).alias("_kept")).distinct()
    moved = at.select(N.parent(F.col("path")).alias("source_path"), N.base_name(F.col("path")).alias("_name"))
    merges = plan.where("kind = 'merge_folder'").select("source_path", F.col("target_path").alias("_into"))
    clash = moved.join(merges, "source_path").select("source_path", F.concat_ws("/", "_into", "_name").alias("target_path")).join(target.select("target_path"), "target_path", "left_semi")
    clash = clash.select("source_path", F.lit(True).alias("_clash")).distinct()
    j = known.join(stays, "target_path", "left").join(clash, "source_path", "left")
    ok = F.when(F.col("kind") == "delete_duplicate", same).when(F.col("kind") == "rename", F.col("_kept").isNull()).when(F.col("kind") == "merge_folder", F.col("_clash").isNull()).otherwise(F.col("kind") == "delete_file")
    return j.select(*plan.columns, F.when(F.col("kind") == "collision", "skipped").when(ok, "applied").otherwise("failed").alias("outcome"))


def moved_paths(items: DataFrame, moves: DataFrame) -> DataFrame:
    """items with the path and name that moves (id, target_path) give them."""
    out = items.join(moves.select("id", F.col("target_path").alias("_to")), "id", "left")
    path = F.coalesce("_to", "path")
    return out.withColumns({"path": path, "filename": N.base_name(path)}).select(*items.columns)


def merged_folders(items: DataFrame, merges: DataFrame) -> DataFrame:
    """items with paths in the folder that theirs is merged into. merges: source_path, target_path."""
    out = items.withColumn("_folder", N.parent(F.col("path"))).join(merges.select(F.col("source_path").alias("_folder"), F.col("target_path").alias("_into")), "_folder", "left")
    return out.withColumn("path", F.when(F.col("_into").isNotNull(), F.concat_ws("/", "_into", N.base_name(F.col("path")))).otherwise(F.col("path"))).select(*items.columns)


def organized(items: DataFrame, outcome: DataFrame) -> DataFrame:
    """The next catalogue after organize_outcome: deleted rows go, renamed ones and those of merged folders have their new paths."""
    done = outcome.where("outcome = 'applied'")
    kept = items.join(done.where("kind IN ('delete_duplicate', 'delete_file')").select(F.col("rom_id").alias("id")), "id", "left_anti")
    merged = merged_folders(kept, done.where("kind = 'merge_folder'"))
    return moved_paths(merged, done.where("kind = 'rename'").select(F.col("rom_id").alias("id"), "target_path"))


def without_other_roots(items: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): rows of another library root go; those without a root stay."""
    other = F.coalesce(F.col("library_root") != root, F.lit(False))
    return items.where(~other), items.where(other)


def with_identity(items: DataFrame, matches: DataFrame) -> DataFrame:
    """items with what the registry says of matched ones: name and title are overwritten, region and revision where it knows them, BIOS files stay BIOS files.

    matches: id, game_name, region, revision, is_bios.
    """
    m = matches.select("id", F.col("game_name").alias("_name"), F.col("region").alias("_region"), F.col("revision").alias("_revision"), F.col("is_bios").alias("_bios"))
    hit = F.col("_name").isNotNull()
    title = F.coalesce(F.nullif(N.clean_name(F.col("_name")), F.lit("")), "_name")
    new = {
        "canonical_name": F.coalesce("_name", "canonical_name"),
        "title": F.when(hit, title).otherwise(F.col("title")),
        "region": F.coalesce("_region", "region"),
        "revision": F.coalesce("_revision", "revision"),
        "is_bios": F.coalesce("_bios", F.lit(False)) | F.col("is_bios"),
        "dat_match": F.coalesce("_name", "dat_match"),
        "match_confidence": F.when(hit, "dat_verified").otherwise(F.col("match_confidence")),
    }
    return items.join(m, "id", "left").withColumns({k: v for k, v in new.items() if k in items.columns}).select(*items.columns)


def scrubbed(items: DataFrame, hashes: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, hashes) after scrub actions (id, status, disk_size, disk_mtime): rows outside the root go, flags are set and taken off, drifted rows get the file's size and time and lose their hash."""
    j = items.join(actions.select("id", F.col("status").alias("_status"), "disk_size", "disk_mtime"), "id", "left").where("_status IS NULL OR _status <> 'outside_root'")
    s = F.coalesce("_status", F.lit(""))
    drift = (s == "drift") & F.col("disk_size").isNotNull() & F.col("disk_mtime").isNotNull()
    out = j.withColumns({"missing": F.when(s == "missing_unflagged", True).when(s == "flagged_but_present", False).otherwise(F.col("missing")), "size_bytes": F.when(drift, F.col("disk_size")).otherwise(F.col("size_bytes")), "mtime": F.when(drift, F.col("disk_mtime")).otherwise(F.col("mtime"))})
    gone = actions.where("status = 'outside_root' OR (status = 'drift' AND disk_size IS NOT NULL AND disk_mtime IS NOT NULL)").select(F.col("id").alias("rom_id"))
    return out.select(*items.columns), hashes.join(gone, "rom_id", "left_anti")


def synced(inventory: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, fetched) after a sync plan (kind, rel_path, rom_id, size_bytes, resolution): conflicts go the way of their resolution, skip and prompt leave them.

    inventory: rel_path, size_bytes, rom_id; fetched: rel_path, size_bytes of the files that come to the library.
    """
    to_dest = plan.where("kind = 'copy_to_dest' OR (kind = 'conflict' AND resolution = 'local')").select("rel_path", "size_bytes", "rom_id")
    gone = plan.where("kind = 'delete_dest'").select("rel_path")
    kept = inventory.select("rel_path", "size_bytes", "rom_id").join(gone, "rel_path", "left_anti")
    fetched = plan.where("kind = 'copy_to_local' OR (kind = 'conflict' AND resolution = 'dest')").select("rel_path", "size_bytes")
    return replace_rows(kept, first_wins(to_dest, ["rel_path"], [F.col("rom_id")]), ["rel_path"]), fetched


def copied_covers(covers: DataFrame, donors: DataFrame) -> DataFrame:
    """covers with those of each item's donor (donors: rom_id, donor_id), but for files that the item has; then one of each item and type is preferred.

    covers: id, rom_id, cover_type, local_path, is_preferred (0 or 1). New rows have no id; among them the path decides.
    """
    own = donors.where("rom_id <> donor_id").join(covers.select(F.col("rom_id").alias("donor_id"), "cover_type", "local_path"), "donor_id").select("rom_id", "cover_type", "local_path").distinct()
    new = own.join(covers.select("rom_id", "local_path"), ["rom_id", "local_path"], "left_anti")
    every = covers.unionByName(new.select(F.lit(None).cast("long").alias("id"), "rom_id", "cover_type", "local_path", F.lit(0).cast(covers.schema["is_preferred"].dataType).alias("is_preferred")))
    ranked = every.withColumn("_place", F.concat(F.lpad(F.coalesce("id", F.lit(2**62)).cast("string"), 20, "0"), F.lit(" "), "local_path"))
    return preferred_first(ranked, ["rom_id", "cover_type"], "is_preferred", "_place").drop("_place")


def without_cache(inventory: DataFrame, destinations: DataFrame, dest_id: int) -> tuple[DataFrame, DataFrame]:
    """(inventory, destinations) without what is known of a destination's files: its rows and its signature go."""
    cleared = F.when(F.col("id") == dest_id, F.lit(None)).otherwise(F.col("signature"))
    return inventory.where(F.col("dest_id") != dest_id), destinations.withColumn("signature", cleared.cast("string"))


def rescanned(destinations: DataFrame, inventory: DataFrame, present: DataFrame, signatures: DataFrame) -> DataFrame:
    """The next inventory of all destinations: where the signature drifted nothing is known any more, elsewhere unchanged files keep their sha1 and rom_id; absent files go.

    destinations: id, signature (null or blank: first visit); inventory and present: dest_id, rel_path, size_bytes, mtime, the former with sha1, rom_id; signatures: dest_id, signature.
    """
    now = signatures.select("dest_id", F.col("signature").alias("_now"))
    known = destinations.select(F.col("id").alias("dest_id"), F.col("signature").alias("_before")).join(now, "dest_id")
    trusted = known.where("coalesce(_before, '') = '' OR _before = _now").select("dest_id")
    old = inventory.join(trusted, "dest_id", "left_semi").select("dest_id", "rel_path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), "sha1", "rom_id")
    j = present.join(old, ["dest_id", "rel_path"], "left")
    same = (F.col("size_bytes") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return j.select("dest_id", "rel_path", "size_bytes", "mtime", F.when(same, F.col("sha1")).alias("sha1"), F.when(same, F.col("rom_id")).alias("rom_id"))


def with_history(history: DataFrame, runs: DataFrame) -> DataFrame:
    """history with new runs (scan_id and any of its columns); a run that is there takes the values that aren't null."""
    new = runs.select(*(F.col(c) if c in runs.columns else F.lit(None).cast(history.schema[c].dataType).alias(c) for c in history.columns))
    a, b = history.alias("a"), new.alias("b")
    return a.join(b, F.col("a.scan_id") == F.col("b.scan_id"), "full").select(*(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in history.columns))


def configured(config: DataFrame, changes: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value with changes in place of old values, and defaults of keys that aren't there."""
    return insert_ignore(replace_rows(config, first_wins(changes, ["key"], [F.col("value")]), ["key"]), defaults, ["key"])
