"""The registry of systems: reloads, the table that it seeds, and what depends on systems that are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.catalogue import insert_ignore


def reload(current: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the registry, problems): the loaded set (see registry_systems) as a whole, or the current one if any entry has a problem.

    problems: file, id, problem of the entries that don't count, such as ids that two files have. Whether there is one is all that the driver learns.
    """
    problems = loaded.where("problem IS NOT NULL").select("file", "id", "problem")
    return (loaded.where("problem IS NULL").select(*current.columns) if problems.isEmpty() else current), problems


def seed(table: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the next table, the rows it got): systems whose id isn't there are added, those that are there stay as they are."""
    new = registry.select(*table.columns).join(table.select("id"), "id", "left_anti")
    return insert_ignore(table, new, ["id"]), new.dropDuplicates(["id"])


def orphans(items: DataFrame, registry: DataFrame) -> DataFrame:
    """items whose system the registry doesn't have any more (those without a system aren't)."""
    return items.where("system_id IS NOT NULL").join(registry.select(F.col("id").alias("system_id")), "system_id", "left_anti")


def known_extensions(systems: DataFrame) -> DataFrame:
    """Every extension that any system takes, in small letters, once."""
    return systems.select(F.explode("extensions").alias("e")).where("e IS NOT NULL").select(F.lower("e").alias("extension")).distinct()
