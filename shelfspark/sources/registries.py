"""Readers of registries and lookup files: all through Spark's XML, text and JSON readers with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from shelfspark.functions import names as N
from shelfspark.operators.resolve import first_wins, tier_ladder

# Fields of the formats.
ROM_FIELDS = ["name", "size", "crc", "md5", "sha1"]
TITLE_FIELDS = {"title": "Name", "platform": "Platform", "description": "Overview", "genre": "Genres", "developer": "Developer", "publisher": "Publisher", "release_date": "ReleaseDate", "players": "MaxPlayers", "rating": "ESRB"}
REGISTRY_EXTENSIONS = [".dat", ".xml"]
DIMENSIONS = ["developer", "esrb", "franchise", "genre", "maxusers", "publisher", "releaseyear"]
JSON_FIELDS = ["crc32", "title", "release_name", "region", "publisher", "developer", "genre", "release_date", "description", "players", "rating"]

_STRING = StringType()
_CORRUPT = "_corrupt_record"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _file_name() -> Column:
    """Of the file that a row comes from; Spark gives it percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _first(tags: Column, test) -> Column:
    return N.first_tag(tags, test)


def registry_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each <rom> of the <game>s in Logiqx files: dat_file, game_name, rom_name, size_bytes, crc32, md5, sha1, region, revision, is_bios.

    Records that can't be parsed (entities, broken elements) and blank names give no row. Hashes are trimmed and in small letters.
    """
    rom = StructType([StructField(f"_{n}", _STRING) for n in ROM_FIELDS])
    schema = StructType([StructField("_name", _STRING), StructField("_isbios", _STRING), StructField("rom", ArrayType(rom)), StructField(_CORRUPT, _STRING)])
    games = _registry_xml(spark, paths, "game", schema)
    games = games.where(F.col(_CORRUPT).isNull())
    rows = games.select("dat_file", F.trim("_name").alias("game_name"), (F.lower(F.coalesce("_isbios", F.lit("no"))) == "yes").alias("is_bios"), F.explode("rom").alias("r"))
    tokens = N.registry_tokens(F.col("game_name"))
    out = rows.select(
        "dat_file",
        "game_name",
        F.trim("r._name").alias("rom_name"),
        F.col("r._size").try_cast("long").alias("size_bytes"),
        *(_blank_to_null(F.lower(f"r._{a}")).alias(b) for a, b in (("crc", "crc32"), ("md5", "md5"), ("sha1", "sha1"))),
        *(tokens[c].alias(c) for c in ("region", "revision", "title", "is_hack", "is_homebrew")),
        "is_bios",
    )
    return out.where("game_name <> '' AND rom_name <> ''")


def registry_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """dat_file and the name in its header."""
    schema = StructType([StructField("name", _STRING)])
    rows = _registry_xml(spark, paths, "header", schema)
    return rows.select("dat_file", F.trim("name").alias("header_name")).where("header_name <> ''").dropDuplicates(["dat_file"])


def load_registries(spark: SparkSession, paths: str | list[str], systems: DataFrame) -> DataFrame:
    """Entries of all registries under the paths, with their systems; ids and duplicates are left to who keeps them. systems: id, dat_name, dat_name_aliases."""
    return with_systems(registry_entries(spark, paths), registry_headers(spark, paths), systems)


def with_systems(entries: DataFrame, headers: DataFrame, systems: DataFrame) -> DataFrame:
    """entries with the system whose dat_name or alias is their file's header name, in any case. systems: id, dat_name, dat_name_aliases."""
    named = systems.select("id", F.explode(F.array_append(F.coalesce("dat_name_aliases", F.array().cast("array<string>")), F.col("dat_name"))).alias("n")).where("n IS NOT NULL")
    named = first_wins(named.select(F.lower("n").alias("_n"), F.col("id").alias("system_id")), ["_n"], [F.col("system_id")])
    found = headers.join(named, F.lower("header_name") == F.col("_n")).select("dat_file", "system_id")
    return entries.join(found, "dat_file", "left")


def _dimension_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of dimension texts with their place; read block by block, not as whole files."""
    # every block starts a record: the separator is the block's opening
    blocks = spark.read.option("lineSep", "\ngame").option("recursiveFileLookup", "true").text(_paths(paths))
    crc = N.crc_key(F.regexp_extract("value", r"(?i)\brom\s*\(\s*crc\s+([0-9A-Fa-f]+)", 1), clamp=True)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return blocks.select("value", crc.alias("crc"), folder.alias("folder"), _file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).where("crc IS NOT NULL")


def _dimension(name: str) -> Column:
    return F.trim(F.regexp_extract("value", rf'(?i)\b{name}\s+"([^"]*)"', 1))


def dimension_values(spark: SparkSession, paths: str | list[str], dimension: str) -> DataFrame:
    """crc, value of one dimension's text files, the first value of a crc in its file. Files are taken in the order of their names."""
    rows = _dimension_blocks(spark, paths).select("crc", _dimension(dimension).alias("value"), "file", "start", "at").where("value <> ''")
    return first_wins(rows, ["crc"], [F.col("file"), F.col("start"), F.col("at")]).select("crc", "value")


def dimension_index(values: dict[str, DataFrame]) -> DataFrame:
    """One row for each crc with a column for each dimension."""
    rows = None
    for name, df in values.items():
        own = df.select("crc", F.lit(name).alias("dimension"), "value")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("crc").pivot("dimension", list(values)).agg(F.min("value"))


def dimension_table(spark: SparkSession, root: str, systems: DataFrame) -> DataFrame:
    """system_id, crc and the DIMENSIONS of the texts <root>/<dimension>/<file name of a system>.dat, all read in one pass. systems: id, dimension_name."""
    value = F.coalesce(*(F.when(F.col("folder") == d, _dimension(d)) for d in DIMENSIONS))
    rows = _dimension_blocks(spark, root).select(N.stem(F.col("file")).alias("dimension_name"), F.col("folder").alias("dimension"), "crc", value.alias("value"), "start", "at").where("value <> ''")
    named = rows.join(systems.select(F.col("id").alias("system_id"), "dimension_name"), "dimension_name")
    first = first_wins(named, ["system_id", "crc", "dimension"], [F.col("start"), F.col("at")])
    return first.groupBy("system_id", "crc").pivot("dimension", DIMENSIONS).agg(F.min("value"))


def dimension_match(items: DataFrame, index: DataFrame) -> DataFrame:
    """items (system_id, crc) with the dimensions of their system's entry for their crc; only items that have one."""
    return items.join(index, ["system_id", "crc"])


def json_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each entry of JSON files {key: {fields}}: file, ord, entry_key and the fields. A file that isn't such an object gives none.

    A file is one JSON value and so one row of text first (lookup files hold thousands of entries).
    """
    entry = StructType([StructField(n, _STRING) for n in JSON_FIELDS])
    raw = spark.read.text(_paths(paths), wholetext=True).select(_file_name().alias("file"), "value")
    rows = raw.select("file", F.posexplode(F.from_json("value", MapType(_STRING, _STRING))).alias("ord", "entry_key", "text"))
    rows = rows.where(F.col("text").startswith("{")).withColumn("e", F.from_json("text", entry))
    return rows.select("file", "ord", "entry_key", "e.*")


def json_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first entry of each crc, first entry of each title key); keys of titles come before those of release names within an entry."""
    order = [F.col("file"), F.col("ord")]
    by_crc = first_wins(entries.withColumn("crc", N.crc_key(F.col("crc32"), clamp=False)), ["crc"], order)
    keys = F.array_compact(F.array(N.title_key(F.col("title")), N.title_key(F.col("release_name"))))
    by_title = first_wins(entries.withColumn("title_key", F.explode(keys)).where("title_key <> ''"), ["title_key"], order)
    return by_crc, by_title


def json_match(items: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """items (crc, canonical_key, title_key) with fields of the entry by crc, then by either title key."""
    by_crc, by_title = json_index(entries)
    side = by_title.select("title_key", *fields)
    tiers = [(by_crc.select("crc", *fields), ["crc"]), (side.withColumnRenamed("title_key", "canonical_key"), ["canonical_key"]), (side, ["title_key"])]
    return tier_ladder(items, tiers, fields)


def title_entries(spark: SparkSession, paths: str | list[str], platforms: DataFrame) -> DataFrame:
    """<Game> records of a title file with the system of their platform (null where unmapped); records without a name go. platforms: platform, system_id."""
    schema = StructType([StructField(tag, _STRING) for tag in TITLE_FIELDS.values()])
    rows = spark.read.format("xml").option("rowTag", "Game").schema(schema).load(_paths(paths))
    order = [_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")]
    rows = rows.select(*(_blank_to_null(F.col(tag)).alias(n) for n, tag in TITLE_FIELDS.items()), *order).where("title IS NOT NULL")
    return rows.join(first_wins(platforms, ["platform"], [F.col("system_id")]), "platform", "left")


def title_match(items: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """items (title, system_id) with fields of the last entry of their system and title, else of the last one without a system."""
    keyed = entries.withColumn("_key", N.title_key_ascii(F.col("title")))
    place = F.struct("file", "start", "at")
    last = lambda df, keys: df.groupBy(*keys).agg(F.max_by(F.struct(*fields), place).alias("e")).select(*keys, "e.*")
    own = last(keyed.where("system_id IS NOT NULL"), ["system_id", "_key"])
    loose = last(keyed.where("system_id IS NULL"), ["_key"])
    out = tier_ladder(items.withColumn("_key", N.title_key_ascii(F.col("title"))), [(own, ["system_id", "_key"]), (loose, ["_key"])], fields)
    return out.drop("_key")


def _registry_xml(spark: SparkSession, paths: str | list[str], tag: str, schema: StructType) -> DataFrame:
    """Records of files as they are named, and of all registry files below folders (paths without an extension); a file that both name counts once."""
    reader = spark.read.format("xml").option("rowTag", tag).option("columnNameOfCorruptRecord", _CORRUPT).schema(schema)
    names = [p.rstrip("/") for p in ([paths] if isinstance(paths, str) else paths)]
    below = lambda p, folders: any(p.startswith(f + "/") for f in folders)
    folders = sorted({p for p in names if not os.path.splitext(p)[1]})
    folders = [p for p in folders if not below(p, folders)]
    files = sorted({p for p in names if os.path.splitext(p)[1] and not (p.endswith(tuple(REGISTRY_EXTENSIONS)) and below(p, folders))})
    found = [reader.load(files)] if files else []
    if folders:
        found.append(reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(REGISTRY_EXTENSIONS) + "}").load(folders))
    rows = [df.withColumn("dat_file", _file_name()) for df in found]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def _paths(paths: str | list[str]) -> str | list[str]:
    return paths if isinstance(paths, str) else sorted(set(paths))
