"""The library scan as one transform, and loads of registry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.catalogue import registry_match, replace_rows, upsert
from shelfspark.sources import tree as T
from shelfspark.sources.shared import written


def scan_library(catalogue: DataFrame, listing: DataFrame, systems: DataFrame, root: str, *, scope: str | None = None) -> DataFrame:
    """The next catalogue: files are given their system, accepted, parsed and merged; rows that the scan didn't meet are missing.

    catalogue: path and the columns of library_rows, kept apart by path; listing: path, rel_path, filename, size_bytes, mtime; systems: id, ord,
    folder_aliases, extensions; scope: only this system is scanned, and only its rows can turn missing.
    """
    return _merged(catalogue, judged(listing, systems, scope).where("verdict = 'found'"), root, scope)


def judged(listing: DataFrame, systems: DataFrame, scope: str | None = None) -> DataFrame:
    """listing with system_id and verdict: skipped (a side file, no system or not one of its files, another system than the scope), error (no size: it couldn't be read) or found."""
    known = systems.select(F.col("id").alias("system_id"), F.col("extensions").alias("_known"))
    own = T.resolve_systems(listing, T.alias_table(systems)).join(known, "system_id", "left")
    ext = N.extension(F.col("filename"))
    wanted = ~ext.isin(N.SIDE_EXTENSIONS) & F.col("system_id").isNotNull() & (ext.isin(N.ARCHIVES) | F.coalesce(F.array_contains("_known", ext), F.lit(False)))
    if scope is not None:
        wanted &= F.col("system_id") == scope
    return own.select(*listing.columns, "system_id", F.when(~F.coalesce(wanted, F.lit(False)), "skipped").when(F.col("size_bytes").isNull(), "error").otherwise("found").alias("verdict"))


def _merged(catalogue: DataFrame, found: DataFrame, root: str, scope: str | None) -> DataFrame:
    new = T.library_rows(found, root).select(*catalogue.columns)
    merged = upsert(catalogue, new)
    met = found.select("path", F.lit(True).alias("_met")).distinct()
    asked = F.lit(True) if scope is None else F.col("system_id") == scope
    return merged.join(met, "path", "left").withColumn("missing", F.when(F.col("_met").isNull() & asked, True).otherwise(F.col("missing"))).select(*catalogue.columns)


def scan_counted(catalogue: DataFrame, listing: DataFrame, systems: DataFrame, root: str, *, scope: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(scan_library's catalogue, counters of the run): files_found, files_with_system, files_skipped, errors, systems_seen.

    The counters are observed while the files found are written, so the listing is read once. A stage that Spark runs again
    after a loss may be counted twice: then the counters are too large, never the catalogue.
    """
    run = Observation("scan")
    found = F.col("verdict") == "found"
    counts = {"files_found": F.count_if(found), "files_with_system": F.count_if(found & F.col("system_id").isNotNull()), "files_skipped": F.count_if(F.col("verdict") == "skipped"), "errors": F.count_if(F.col("verdict") == "error"), "systems_seen": F.size(F.collect_set(F.when(found, F.col("system_id"))))}
    rows = judged(listing, systems, scope).observe(run, *(c.alias(n) for n, c in counts.items()))
    met = written(rows.where(found).drop("verdict"), "found")
    return _merged(catalogue, met, root, scope), {n: run.get[n] for n in counts}


def load_registry(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with those of loaded files; a file that is loaded again replaces what it gave before (column dat_file)."""
    return replace_rows(entries, new.select(*entries.columns), ["dat_file"])


def matched(items: DataFrame, registry: DataFrame) -> DataFrame:
    """id, game_name, region, revision, is_bios of the registry entry of each item that has one. registry: entry_id, sha1, weak, size_bytes and those columns."""
    hit = registry_match(items, registry).where("entry_id IS NOT NULL").select("id", "entry_id")
    return hit.join(registry.select("entry_id", "game_name", "region", "revision", "is_bios"), "entry_id").drop("entry_id")
