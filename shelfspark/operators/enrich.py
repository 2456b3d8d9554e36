"""Covers, enrichment and export: candidates, ladders and classes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.catalogue import sibling_donor
from shelfspark.operators.lookups import cover_candidates, within
from shelfspark.sources.shared import shared_dir
from shelfspark.sources.tree import listings

# Fixed values.
COVER_TYPES = ["Named_Boxarts", "Named_Snaps", "Named_Titles"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp"]
SKIPPED_FOLDERS = ["backup", "backups", "logs_arrm", "logs", ".git", ".svn", "__pycache__", "node_modules"]
IMAGE_DEPTH = 4


def image_bucket(images: DataFrame) -> DataFrame:
    """Images (system_id, image_path) with their key, without release, and cover type; images without a key go."""
    name = N.base_name(F.col("image_path"))
    key = N.fuzzy_key(N.clean_name(N.stem(name)))
    out = images.where(N.extension(name).isin(IMAGE_EXTENSIONS)).select("system_id", "image_path", key.alias("image_key"), N.cover_kind(F.col("image_path")).alias("cover_type"))
    return out.where("image_key <> ''")


def candidate_keys(path: Column, key: Column, clean: Column) -> Column:
    """Keys to look images up by, in order of preference: loose forms of key, stem and title, then key and stem with their release."""
    stem = N.stem(N.base_name(path))
    own = lambda s: N.bound(N.fuzzy_key(N.clean_name(s)), lambda k: F.array(k, N.with_release(k, N.first_tag(N.paren_tags(s), N.is_release))))
    keys = lambda o: F.array(F.substring_index(key, "__", 1), F.get(o, F.lit(0)), N.fuzzy_key(clean), key, F.get(o, F.lit(1)))
    every = N.bound(N.bound(stem, own), keys)
    return F.array_distinct(F.filter(every, lambda k: k.isNotNull() & (k != "")))


def local_covers(items: DataFrame, images: DataFrame) -> DataFrame:
    """id, image_path, cover_type and the place of the first key that found the image.

    items: id, system_id, path, fuzzy_key, clean_name; images: system_id, image_path.
    """
    keys = candidate_keys(F.col("path"), F.col("fuzzy_key"), F.col("clean_name"))
    wanted = items.select("id", "system_id", F.posexplode(keys).alias("key_rank", "image_key"))
    found = wanted.join(image_bucket(images), ["system_id", "image_key"])
    return found.groupBy("id", "image_path").agg(F.min("key_rank").alias("key_rank"), F.min("cover_type").alias("cover_type"))


def new_covers(found: DataFrame, covers: DataFrame) -> DataFrame:
    """Found covers whose file an item doesn't have yet. covers: id, local_path."""
    return found.join(covers.select("id", F.col("local_path").alias("image_path")), ["id", "image_path"], "left_anti")


def discover_covers(items: DataFrame, covers: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The next covers after a search for images on disk: items with a key and without box art are matched with the images below their own folder.

    items: id, path, fuzzy_key, dat_match; covers: id, rom_id, cover_type, local_path, is_preferred (0 or 1); ids: only these items.
    Folders are walked in tasks, each once, however many items it has. Images that an item has are left out; new rows
    have no id. Of each item and type that got one, the first is preferred where none was: by id, then by the key that found it, then by path.
    """
    asked = cover_candidates(items, covers)
    asked = asked if ids is None else within(asked, ids)
    asked = asked.select("id", N.parent(F.col("path")).alias("system_id"), "path", "fuzzy_key", F.coalesce("dat_match", F.lit("")).alias("clean_name"))
    listed = listings(asked.select(F.col("system_id").alias("root")).distinct(), max_depth=IMAGE_DEPTH + 1, skip=SKIPPED_FOLDERS, hidden=False)
    found = local_covers(asked, listed.select(F.col("root").alias("system_id"), F.col("path").alias("image_path")))
    new = new_covers(found, covers.select(F.col("rom_id").alias("id"), "local_path"))
    flag = covers.schema["is_preferred"].dataType
    fresh = new.select(F.lit(None).cast(covers.schema["id"].dataType).alias("id"), F.col("id").alias("rom_id"), "cover_type", F.col("image_path").alias("local_path"), F.lit(0).cast(flag).alias("is_preferred"), "key_rank")
    every = covers.select("id", "rom_id", "cover_type", "local_path", "is_preferred", F.lit(None).cast("int").alias("key_rank")).unionByName(fresh)
    group = ["rom_id", "cover_type"]
    place = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.coalesce("key_rank", F.lit(0)), F.coalesce("local_path", F.lit("")))
    own = every.withColumn("_place", place)
    chosen = own.groupBy(*group).agg(F.max("is_preferred").alias("_any"), F.max(F.col("key_rank").isNotNull()).alias("_got"), F.min("_place").alias("_first"))
    chosen = chosen.where("_any = 0 AND _got").select(*group, "_first")
    out = own.join(chosen, group, "left")
    return out.select("id", *group, "local_path", F.when(F.col("_place") == F.col("_first"), F.lit(1).cast(flag)).otherwise(F.col("is_preferred")).alias("is_preferred"))


def cover_fetches(items: DataFrame, covers: DataFrame) -> DataFrame:
    """id and cover_type of the covers to fetch: each of three types that an item has no cover of. covers: id, cover_type."""
    wanted = items.select("id", F.explode(F.array(*map(F.lit, COVER_TYPES))).alias("cover_type"))
    return wanted.join(covers.select("id", "cover_type"), ["id", "cover_type"], "left_anti")


def localized(json: Column, path: str, languages: list[str]) -> Column:
    """The text of a field that is a string, an object with text or texte, or a list of such objects; of a list the first in language order, else the first."""
    value = F.get_json_object(json, path)
    shape = "array<struct<langue:string,region:string,text:string,texte:string>>"
    listed = F.filter(F.when(value.startswith("["), F.from_json(value, shape)), lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), F.nullif(x["texte"], F.lit(""))).isNotNull())
    text = lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), F.nullif(x["texte"], F.lit("")))
    of = lambda lang: F.filter(listed, lambda x: F.coalesce(x["langue"], x["region"]) == lang)
    picks = [text(F.get(of(lang), F.lit(0))) for lang in languages]
    one = F.when(value.startswith("{"), F.coalesce(F.nullif(F.get_json_object(value, "$.text"), F.lit("")), F.nullif(F.get_json_object(value, "$.texte"), F.lit(""))))
    plain = F.when(~value.startswith("{") & ~value.startswith("["), F.nullif(value, F.lit("")))
    return F.coalesce(*picks, text(F.get(listed, F.lit(0))), one, plain)


def export_status(items: DataFrame, mappings: DataFrame, source: DataFrame, dest: DataFrame, *, base_path: str = "", include_files: bool = True) -> DataFrame:
    """items with dest_path and status: unsupported, artwork_only, source_missing, already_present, refused (another file is there) or copy.

    items: id, system_id, path, filename, size_bytes; mappings: system_id, folder, supported; source: path; dest: rel_path, size_bytes.
    """
    base = [F.lit(base_path.strip("/"))] if base_path.strip("/") else []
    m = mappings.where(F.col("supported") & (F.col("folder") != "")).dropDuplicates(["system_id"]).select("system_id", F.col("folder").alias("_folder"))
    there = source.select("path").distinct().withColumn("_there", F.lit(True))
    j = items.join(m, "system_id", "left").withColumn("dest_path", F.when(F.col("_folder").isNotNull(), F.concat_ws("/", *base, "_folder", "filename")))
    j = j.join(there, "path", "left").join(dest.select(F.col("rel_path").alias("dest_path"), F.col("size_bytes").alias("_size")), "dest_path", "left")
    status = (
        F.when(F.col("_folder").isNull(), "unsupported")
        .when(F.lit(not include_files), "artwork_only")
        .when(F.col("_there").isNull(), "source_missing")
        .when(F.col("_size") == F.coalesce("size_bytes", F.lit(0)), "already_present")
        .when(F.col("_size").isNotNull(), "refused")
        .otherwise("copy")
    )
    return j.select(*items.columns, "dest_path", status.alias("status"))


def spread_to_siblings(values: DataFrame, items: DataFrame, keys: list[list[str]]) -> DataFrame:
    """values (id, value) and what items without one get from siblings, round after round until nothing is new.

    A copy can be a donor in the next round through another key. The donor is the least id of the first key that has one.
    Each round is a written table, so lost executors take no rounds with them.
    """
    spark, have = values.sparkSession, values.select("id", "value")
    while True:
        donors = items.join(have, "id")
        found = sibling_donor(items.join(have.select("id"), "id", "left_anti"), donors, keys).where("donor_id IS NOT NULL")
        got = found.select("id", "donor_id").join(have.withColumnRenamed("id", "donor_id"), "donor_id").select("id", "value")
        path = shared_dir(spark, "siblings")
        got.write.parquet(path)
        got = spark.read.schema(got.schema).parquet(path)
        if got.isEmpty():
            return have
        have = have.unionByName(got)


def sibling_cover_classes(targets: DataFrame, covers: DataFrame, keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """(members: id, tier, class; classes: class, rom_id, cover_id): which group of covers each item may take, and the covers of every group that an item has.

    targets: id and the keys; covers: cover_id, rom_id and the keys. A class is a tier with its keys; an item belongs to that of the first keys by which another item
    has a cover. Both grow with items and covers, not with their pairs: who shows an item's covers joins its class and leaves out its own.
    """
    best = None
    for n, k in enumerate(keys, start=1):
        # a key that only the item itself has covers of finds nothing
        owners = covers.groupBy(*k).agg(F.min("rom_id").alias("_low"), F.max("rom_id").alias("_high"))
        hit = targets.join(owners, k).where((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))).select("id", F.struct(F.lit(n).alias("tier"), _class(n, k).alias("class")).alias("_found"))
        best = hit if best is None else best.unionByName(hit)
    members = best.groupBy("id").agg(F.min("_found").alias("_found")).select("id", "_found.tier", "_found.class")
    every = None
    for n, k in enumerate(keys, start=1):
        own = covers.where(" AND ".join(f"{c} IS NOT NULL" for c in k)).select(_class(n, k).alias("class"), "rom_id", "cover_id")
        every = own if every is None else every.unionByName(own)
    return members, every.join(members.select("class").distinct(), "class", "left_semi")


def _class(tier: int, keys: list[str]) -> Column:
    return F.to_json(F.array(F.lit(str(tier)), *(F.col(k).cast("string") for k in keys)))


def sibling_covers(targets: DataFrame, covers: DataFrame, keys: list[list[str]]) -> DataFrame:
    """id, cover_id, tier: all covers of the first keys by which an item has any; not its own. A row for each pair; sibling_cover_classes has the same without pairs."""
    members, classes = sibling_cover_classes(targets, covers, keys)
    return members.join(classes, "class").where("id <> rom_id").select("id", "cover_id", "tier")


def set_preferred(covers: DataFrame, chosen: DataFrame) -> DataFrame:
    """covers (id, rom_id, cover_type, is_preferred) where of each group with a chosen cover that one alone is preferred (of several the least id)."""
    group = ["rom_id", "cover_type"]
    best = covers.join(chosen.select("id").distinct(), "id", "left_semi").groupBy(*group).agg(F.min("id").alias("_best"))
    out = covers.join(best, group, "left")
    return out.withColumn("is_preferred", F.when(F.col("_best").isNull(), F.col("is_preferred")).otherwise(F.col("id") == F.col("_best"))).select(*covers.columns)


def details(items: DataFrame, metadata: DataFrame, hashes: DataFrame, favourites: DataFrame) -> DataFrame:
    """What a detail view shows of each item: display title, registry name, release, short hash, size and membership; blank values are null.

    items: id, filename, title, canonical_name, dat_match, match_confidence, size_bytes; metadata: rom_id, release_date, release_year;
    hashes: rom_id, sha1; favourites: rom_id. One row of metadata and hashes for each item at most.
    """
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    m = metadata.select(F.col("rom_id").alias("id"), F.coalesce(blank("release_date"), blank("release_year")).alias("released"))
    h = hashes.where("sha1 IS NOT NULL").select(F.col("rom_id").alias("id"), N.short_hash(F.col("sha1")).alias("sha1_short"))
    fav = favourites.select(F.col("rom_id").alias("id"), F.lit(True).alias("_fav")).distinct()
    out = items.join(m, "id", "left").join(h, "id", "left").join(fav, "id", "left")
    registry = F.coalesce(F.when(F.col("match_confidence") == "dat_verified", blank("dat_match")), blank("canonical_name"))
    size = F.when(F.col("size_bytes") > 0, N.size_text(F.col("size_bytes")))
    return out.select("id", F.coalesce(blank("canonical_name"), blank("title"), blank("filename"), F.lit("")).alias("display_title"), registry.alias("registry_name"), "released", "sha1_short", size.alias("size_text"), F.col("_fav").isNotNull().alias("is_favourite"))


def destination_systems(files: DataFrame, mappings: DataFrame, base_path: str = "") -> DataFrame:
    """files (rel_path) of a destination with system_id, by their first folder below the base path, and landing_path in the library.

    Leading segments that equal those of the base path in any case are taken off one by one. mappings: system_id, folder; of systems that share
    a folder the least id. A file of no known folder lands in _unsorted.
    """
    parts = F.split("rel_path", "/")
    for segment in (s for s in base_path.replace("\\", "/").split("/") if s):
        parts = F.when(F.lower(F.get(parts, F.lit(0))) == segment.lower(), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    known = mappings.where("folder <> ''").groupBy(F.lower("folder").alias("_folder")).agg(F.min("system_id").alias("system_id"))
    out = files.withColumn("_first", F.lower(F.get(parts, F.lit(0)))).join(known, F.col("_first") == F.col("_folder"), "left")
    return out.select(*files.columns, "system_id", F.concat_ws("/", F.coalesce("system_id", F.lit("_unsorted")), N.base_name(F.col("rel_path"))).alias("landing_path"))


def signature_matches(previous: Column, current: Column) -> Column:
    """A destination without a signature is a first visit and so matches."""
    return F.coalesce(previous, F.lit("")).isin("") | F.coalesce(previous == current, F.lit(False))


def file_totals(files: DataFrame) -> DataFrame:
    """One row: n_files, n_bytes, largest of a listing (size_bytes); zeros if it is empty."""
    zero = F.lit(0)
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), zero).alias("n_bytes"), F.coalesce(F.max("size_bytes"), zero).alias("largest"))
