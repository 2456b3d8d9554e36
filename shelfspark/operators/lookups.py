"""Lookups, scopes, candidate sets and existence flags over a catalogue snapshot.

items: id, path, filename, system_id, size_bytes, mtime, sha1, region, match_confidence, fuzzy_key, missing, library_root as far as a function names them.
Listings come unordered; who shows them orders them by the columns that a docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.resolve import first_wins

# Fixed values of the grid's buckets.
KNOWN_REGIONS = ["USA", "Europe", "Japan", "World"]
VERIFIED = ["dat_verified", "header"]


def of_system(items: DataFrame, system_id: str) -> DataFrame:
    """A system's items; listed by filename."""
    return items.where(F.col("system_id") == system_id)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def by_path(items: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """wanted with the id of the item at each path, whichever way its slashes lean (of several the least id)."""
    known = items.groupBy(slashes(F.col("path")).alias("_at")).agg(F.min("id").alias("id"))
    return wanted.join(known, slashes(F.col(path)) == F.col("_at"), "left").drop("_at")


def first_of(items: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """wanted (column) with the least id of the items that have the value."""
    return wanted.join(first_wins(items.select(column, "id"), [column], [F.col("id")]), column, "left")


def root_counts(items: DataFrame, root: str) -> DataFrame:
    """One row: how many items are missing, and how many belong to another library root (those without one don't)."""
    count = lambda c: F.count(F.when(c, 1))
    return items.agg(count(F.col("missing")).alias("n_missing"), count(F.col("library_root") != root).alias("n_other_root"))


def grid(items: DataFrame, *, text: str = "", region: str | None = None, confidence: str | None = None, enriched: bool | None = None) -> DataFrame:
    """Rows that a grid shows: part of the name in any case, a region ('Other': none of the known ones, 'None': no region), Verified or a confidence, enrichment state (column has_metadata)."""
    name, own = F.coalesce("filename", F.lit("")), F.coalesce("region", F.lit(""))
    keep = F.contains(F.lower(name), F.lit(text.lower()))
    if region == "Other":
        keep &= (own != "") & ~own.isin(KNOWN_REGIONS)
    elif region == "None":
        keep &= own == ""
    elif region:
        keep &= own == region
    if confidence == "Verified":
        keep &= F.col("match_confidence").isin(VERIFIED)
    elif confidence:
        keep &= F.col("match_confidence") == confidence
    if enriched is not None:
        keep &= F.col("has_metadata") == F.lit(enriched)
    return items.where(keep)


def export_candidates(items: DataFrame, *, systems: list[str] = (), regions: list[str] = (), members: DataFrame | None = None) -> DataFrame:
    """Items of a system that an export takes; listed by (system_id, filename). 'Other' among the regions adds items without one. members: rom_id."""
    keep = F.col("system_id").isNotNull()
    if systems:
        keep &= F.col("system_id").isin(*systems)
    if regions:
        own = F.col("region").isin(*regions)
        keep &= own | F.col("region").isNull() if "Other" in regions else own
    out = items.where(keep)
    return out if members is None else out.join(members.select(F.col("rom_id").alias("id")), "id", "left_semi")


def scope(items: DataFrame, members: DataFrame, *, rom_id: int | None = None, system_id: str | None = None, collection_id: int | None = None) -> DataFrame:
    """id of the items in a scope, the narrowest that is given: item, system, collection (members: collection_id, rom_id); none gives no rows."""
    if rom_id is not None:
        return items.where(F.col("id") == rom_id).select("id")
    if system_id is not None:
        return of_system(items, system_id).select("id")
    if collection_id is not None:
        return members.where(F.col("collection_id") == collection_id).select(F.col("rom_id").alias("id"))
    return items.select("id").limit(0)


def within(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Only rows of a scope."""
    return df.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def enrichment_candidates(items: DataFrame, metadata: DataFrame, *, include_fuzzy: bool = False, include_enriched: bool = False) -> DataFrame:
    """Items to look metadata up for, listed by (system_id, title): verified ones without metadata, unless a switch lets others in. metadata: rom_id."""
    out = items if include_fuzzy else items.where("match_confidence = 'dat_verified'")
    return out if include_enriched else out.join(metadata.select(F.col("rom_id").alias("id")), "id", "left_anti")


def cover_candidates(items: DataFrame, covers: DataFrame, cover_type: str | None = "Named_Boxarts") -> DataFrame:
    """Items with a key and, if a cover type is named, without a cover of it. covers: rom_id, cover_type."""
    out = items.where("fuzzy_key IS NOT NULL AND fuzzy_key <> ''")
    return out if cover_type is None else out.join(covers.where(F.col("cover_type") == cover_type).select(F.col("rom_id").alias("id")), "id", "left_anti")


def flags(items: DataFrame, **tables: DataFrame) -> DataFrame:
    """items with a boolean column for each table (rom_id): whether it has a row for the item."""
    for name, t in tables.items():
        items = items.join(t.select(F.col("rom_id").alias("id"), F.lit(True).alias(name)).distinct(), "id", "left").withColumn(name, F.col(name).isNotNull())
    return items


def enrichment_grid(items: DataFrame, systems: DataFrame, metadata: DataFrame, covers: DataFrame, *, system_id: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """id, name, system_id, path, system_name, region, size_bytes, match_confidence, has_metadata, has_covers; listed by name, a page at a time (pages.BY_NAME).

    systems: id, short_name, display_name; metadata and covers: rom_id; system_id and ids (id): only these.
    """
    own = items if system_id is None else of_system(items, system_id)
    own = own if ids is None else within(own, ids)
    named = systems.select(F.col("id").alias("system_id"), F.coalesce("short_name", "display_name").alias("_shown"))
    marked = flags(own, has_metadata=metadata, has_covers=covers).join(named, "system_id", "left")
    return marked.select("id", F.col("filename").alias("name"), "system_id", "path", F.coalesce("_shown", "system_id").alias("system_name"), F.coalesce("region", F.lit("")).alias("region"), "size_bytes", "match_confidence", "has_metadata", "has_covers")


def local_files(items: DataFrame, base: str = "roms") -> DataFrame:
    """rom_id, rel_path, size_bytes, mtime, sha1, fuzzy_key, region, system_id of items as one side of a sync: below base, in a folder of their system."""
    rel_path = F.concat_ws("/", F.lit(base), "system_id", "filename")
    return items.select(F.col("id").alias("rom_id"), rel_path.alias("rel_path"), "size_bytes", "mtime", "sha1", "fuzzy_key", F.coalesce(F.lower("region"), F.lit("")).alias("region"), "system_id")


def destination_at(destinations: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (target_path) with the id of the destination there, of several the least."""
    return wanted.join(destinations.groupBy("target_path").agg(F.min("id").alias("id")), "target_path", "left")


def with_hashes(items: DataFrame, systems: DataFrame, hashes: DataFrame) -> DataFrame:
    """items with header_rule of their system and sha1, hashed_at of their hash row. systems: id, header_rule; hashes: rom_id, sha1, hashed_at."""
    s = systems.select(F.col("id").alias("system_id"), "header_rule")
    h = hashes.select(F.col("rom_id").alias("id"), "sha1", "hashed_at")
    return items.drop("sha1", "hashed_at", "header_rule").join(s, "system_id", "left").join(h, "id", "left")


def to_hash(hashed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Of with_hashes, rows that were never hashed or changed since; ids: only those."""
    out = hashed.where("hashed_at IS NULL OR hashed_at < mtime")
    return out if ids is None else within(out, ids)


def gamelist_rows(dest: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    """filename, system_id, id, canonical_name, title of the files at a destination, as far as its inventory knows their items; game lists and playlists are no games.

    dest: rel_path, system_id; inventory: rel_path, rom_id; items: id, canonical_name, title.
    """
    name = N.base_name(F.col("rel_path"))
    own = dest.withColumn("filename", name).where((F.lower("filename") != "gamelist.xml") & ~F.endswith("filename", F.lit(".m3u")))
    known = inventory.where("rom_id IS NOT NULL").select("rel_path", F.col("rom_id").alias("id")).join(items.select("id", "canonical_name", "title"), "id")
    return own.join(known, "rel_path", "left").select("filename", "system_id", "id", "canonical_name", "title")


def artwork_plan(items: DataFrame, covers: DataFrame, dest: DataFrame, *, template: str = "{stem}{ext}", subdir: str = "media", tolerance: float = 2.0) -> DataFrame:
    """id, source_path, target_path, kind of each item's cover (the preferred one, else that of least id): copy, or current where size and time agree.

    items: id, filename, folder; covers: id, rom_id, local_path, is_preferred, size_bytes, mtime; dest: path, size_bytes, mtime.
    """
    best = first_wins(covers.select(F.col("rom_id"), F.col("id").alias("cover_id"), "local_path", "is_preferred", "size_bytes", "mtime"), ["rom_id"], [-F.col("is_preferred").cast("int"), F.col("cover_id")])
    name = F.replace(F.replace(F.lit(template), F.lit("{stem}"), N.stem(F.col("filename"))), F.lit("{ext}"), N.extension(N.base_name(F.col("local_path"))))
    own = items.select("id", "filename", "folder").join(best.withColumnRenamed("rom_id", "id"), "id").withColumn("target_path", F.concat_ws("/", "folder", F.lit(subdir), name))
    there = dest.select(F.col("path").alias("target_path"), F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("size_bytes") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < tolerance)
    return own.join(there, "target_path", "left").select("id", F.col("local_path").alias("source_path"), "target_path", F.when(same, "current").otherwise("copy").alias("kind"))


def is_image(content: Column) -> Column:
    """Whether bytes begin as PNG or JPEG files do."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce((head == "89504E470D0A1A0A") | F.startswith(head, F.lit("FFD8FF")), F.lit(False))
