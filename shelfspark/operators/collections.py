"""Collections with their members, and sync destinations: each edit gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.operators.catalogue import insert_ignore

MEMBER = ["collection_id", "rom_id"]


def sizes(collections: DataFrame, members: DataFrame) -> DataFrame:
    """collections (id, name, is_system) with n_members, those without any too; system ones come first when they are listed by (is_system desc, name)."""
    n = members.groupBy(F.col("collection_id").alias("id")).agg(F.count("rom_id").alias("n_members"))
    return collections.join(n, "id", "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))


def create(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """collections with new ones (columns of collections); a name that is taken isn't created again."""
    return insert_ignore(collections, wanted.select(*collections.columns), ["name"])


def delete(collections: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, members, refused) without the collections of ids and their members; system collections are refused and stay."""
    asked = ids.select("id").distinct()
    refused = collections.where("is_system").join(asked, "id", "left_semi")
    gone = collections.where("NOT is_system").join(asked, "id", "left_semi").select("id")
    return collections.join(gone, "id", "left_anti"), members.join(gone, F.col("collection_id") == gone["id"], "left_anti"), refused


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    return insert_ignore(members.select(*MEMBER), new.select(*MEMBER), MEMBER)


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select(*MEMBER).distinct(), MEMBER, "left_anti")


def ensure_destinations(destinations: DataFrame, wanted: DataFrame) -> DataFrame:
    """target_path, name, profile_id, is_new of each wanted path: the saved destination of least id, or a new one.

    destinations: id, name, target_path, profile_id; wanted: target_path, profile_id, name (the name it should have). A name that is
    taken gets the next free " (n)" from 2 on, in the order of paths; of several rows of a path the least profile and name count.
    A wanted name that itself ends in such a number counts as a name like any other, so two new rows may meet there.
    """
    saved = destinations.where("target_path IS NOT NULL").groupBy("target_path").agg(F.min_by(F.struct("name", "profile_id"), "id").alias("s"))
    paths = wanted.where("target_path IS NOT NULL").groupBy("target_path").agg(F.min(F.struct("profile_id", "name")).alias("w"))
    both = paths.join(saved, "target_path", "left")
    old = both.where("s IS NOT NULL").select("target_path", "s.name", "s.profile_id", F.lit(False).alias("is_new"))
    new = both.where("s IS NULL").select("target_path", F.col("w.name").alias("base"), "w.profile_id")
    # numbers of a base name that are taken: 1 is the bare name
    bare = destinations.select(F.col("name").alias("base"), F.lit(1).alias("n"))
    numbered = destinations.select(F.regexp_extract("name", r"^(.*) \(([1-9][0-9]{0,8})\)$", 1).alias("base"), F.regexp_extract("name", r" \(([1-9][0-9]{0,8})\)$", 1).try_cast("int").alias("n"))
    taken = bare.unionByName(numbered.where("n >= 2")).join(new.select("base").distinct(), "base", "left_semi").distinct()
    # the k-th free number is k + the taken ones up to it: a taken number t leaves t - rank(t) free ones below it
    below = taken.withColumn("free", F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n")))
    below = below.groupBy("base", "free").agg(F.count("*").alias("c"))
    steps = below.withColumn("shift", F.sum("c").over(Window.partitionBy("base").orderBy("free"))).select("base", F.col("free").alias("k"), "shift", F.lit(None).cast("string").alias("target_path"), F.lit(None).cast(new.schema["profile_id"].dataType).alias("profile_id"))
    asked = new.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("target_path"))).withColumn("shift", F.lit(None).cast("long"))
    # free numbers below t: those k with k <= free(t) aren't shifted by it
    line = asked.select("base", (F.col("k") * 2 - 1).alias("at"), "k", "shift", "target_path", "profile_id").unionByName(steps.select("base", (F.col("k") * 2).alias("at"), "k", "shift", "target_path", "profile_id"))
    last = F.last("shift", ignorenulls=True).over(Window.partitionBy("base").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.col("k") + F.coalesce("last", F.lit(0))
    named = line.withColumn("last", last).where("target_path IS NOT NULL")
    named = named.select("target_path", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), number.cast("string"), F.lit(")"))).alias("name"), "profile_id", F.lit(True).alias("is_new"))
    return old.unionByName(named)
