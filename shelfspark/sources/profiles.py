"""System registries and destination profiles from YAML files.

Files are read by Spark; a task turns each one into JSON (PyYAML, imported there), the rest is Column expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from shelfspark.functions import names as N
from shelfspark.sources.shared import written

_S, _L = StringType(), ArrayType(StringType())
# Fields of the formats.
SYSTEM_FIELDS = {"id": _S, "display_name": _S, "short_name": _S, "manufacturer": _S, "generation": IntegerType(), "extensions": _L, "header_rule": _S, "libretro_name": _S, "folder_aliases": _L, "dat_name": _S, "dat_name_aliases": _L, "gamedb_file": _S}
PROFILE_FIELDS = {"id": _S, "name": _S, "description": _S, "case_sensitive": BooleanType(), "base_path": _S, "gamelist_format": _S, "artwork_subdir": _S, "artwork_filename_template": _S, "multi_disc": _S}
HEADER_RULES = ["smc_512", "ines_16", "n64_byteswap", "lynx_64"]
_MAPPING = StructType([StructField("folder", _S), StructField("extensions", _L), StructField("supported", BooleanType())])


@F.pandas_udf(_S)
def yaml_json(text: pd.Series) -> pd.Series:
    """A file's YAML as JSON; null if it isn't YAML."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same language; libyaml reads it about ten times as fast

    def one(t):
        try:
            return json.dumps(yaml.load(t, loader), default=str)
        except (yaml.YAMLError, ValueError, TypeError, AttributeError):
            return None

    return text.map(one)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", yaml_json("value").alias("json"))


def _struct(fields: dict) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


def registry_systems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ord, the fields of each system, and problem: null, or why the entry doesn't count.

    Extensions and aliases are in small letters. Problems: not_yaml (a whole file), no_systems (a whole file without a list of that
    name; empty files give no row), incomplete (no id or name), extension (without a dot), header_rule, repeated_id (all entries of an id).
    Files are read and parsed once, when this is called; what is made of them reads the entries that were written then.
    """
    files = _files(spark, paths).where("json IS NULL OR json <> 'null'")
    parsed = files.withColumn("s", F.from_json(F.get_json_object("json", "$.systems"), ArrayType(_struct(SYSTEM_FIELDS))))
    rows = parsed.select("file", F.col("json").isNull().alias("unread"), F.col("s").isNull().alias("bad"), F.posexplode_outer("s").alias("ord", "e")).where("bad OR ord IS NOT NULL")
    lower = lambda c: F.transform(F.coalesce(f"e.{c}", F.array().cast("array<string>")), lambda x: F.lower(x))
    fields = [lower(c).alias(c) if c in ("extensions", "folder_aliases") else F.col(f"e.{c}").alias(c) for c in SYSTEM_FIELDS]
    out = written(rows.select("file", "ord", "unread", "bad", *fields), "registry-entries")
    twice = out.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twice"))
    out = out.join(twice, "id", "left")
    problem = (
        F.when(F.col("unread"), "not_yaml")
        .when(F.col("bad"), "no_systems")
        .when(F.col("id").isNull() | F.col("display_name").isNull() | F.col("short_name").isNull(), "incomplete")
        .when(F.exists("extensions", lambda x: ~x.startswith(".")), "extension")
        .when(F.col("header_rule").isNotNull() & ~F.col("header_rule").isin(HEADER_RULES), "header_rule")
        .when(F.col("twice"), "repeated_id")
    )
    return out.select("file", "ord", *SYSTEM_FIELDS, problem.alias("problem"))


def profiles(spark: SparkSession, tiers: list[str | list[str]]) -> DataFrame:
    """One row for each profile id: its fields and systems (map of id to folder, extensions, supported). Later tiers override earlier ones, and within a
    tier later file names. Files that aren't profiles, or whose paths leave the destination, give no row."""
    rows = None
    for k, paths in enumerate(tiers):
        own = _files(spark, paths).withColumn("tier", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    schema = StructType([*_struct(PROFILE_FIELDS).fields, StructField("systems", MapType(_S, _MAPPING))])
    read = rows.where(F.col("json").startswith("{")).withColumn("p", F.from_json("json", schema))
    read = read.withColumn("folders", F.transform(F.map_values(F.coalesce("p.systems", F.from_json(F.lit("{}"), MapType(_S, _MAPPING)))), lambda m: m["folder"]))
    safe = lambda c: F.coalesce(c, F.lit("")).isin("") | F.coalesce(N.valid_relative_path(c), F.lit(False))
    good = read.where(F.col("p.id").isNotNull() & F.col("p.name").isNotNull() & N.valid_relative_path(F.col("p.base_path")) & safe(F.col("p.artwork_subdir")) & F.forall("folders", safe))
    best = good.groupBy("p.id").agg(F.max_by("p", F.struct("tier", "file")).alias("p")).select("p.*")
    return best.withColumns({"case_sensitive": F.coalesce("case_sensitive", F.lit(True)), "artwork_filename_template": F.coalesce("artwork_filename_template", F.lit("{stem}{ext}"))})


def mappings(profiles: DataFrame) -> DataFrame:
    """profile_id, system_id, folder, extensions, supported (a mapping without a folder isn't)."""
    rows = profiles.select(F.col("id").alias("profile_id"), F.explode("systems").alias("system_id", "m"))
    folder = F.coalesce("m.folder", F.lit(""))
    return rows.select("profile_id", "system_id", folder.alias("folder"), F.coalesce("m.extensions", F.array().cast("array<string>")).alias("extensions"), (F.coalesce("m.supported", F.lit(True)) & (folder != "")).alias("supported"))
