"""Plans as data: every action is a row (kind, rom_id, target_rom_id, source_path, target_path, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.resolve import keeper
from shelfspark.sources.shared import written


def duplicates(items: DataFrame) -> DataFrame:
    """Items with a content that an item of better extension, shorter name or smaller id has too; hacks take no part."""
    own = items.where(F.col("sha1").isNotNull() & ~F.col("is_hack"))
    order = [N.extension_rank(F.lower("extension")), F.length("filename"), F.col("id")]
    found = keeper(own, ["sha1"], order, ["id", "path"]).where("group_size > 1 AND id <> keeper_id")
    return found.select(F.lit("delete_duplicate").alias("kind"), F.col("id").alias("rom_id"), F.col("keeper_id").alias("target_rom_id"), F.col("path").alias("source_path"), F.col("keeper_path").alias("target_path"), F.concat(F.lit("same content as "), "keeper_path").alias("reason"))


def renames(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Verified items whose name isn't the registry's."""
    own = items.where("match_confidence = 'dat_verified' AND dat_match <> ''").join(deleted.select(F.col("rom_id").alias("id")), "id", "left_anti")
    name = N.safe_filename(F.col("dat_match"))
    name = F.when(F.endswith(F.lower(name), F.lower("extension")), name).otherwise(F.concat(name, "extension"))
    target = F.concat(N.parent(F.col("path")), F.lit("/"), name)
    return own.withColumn("target_path", target).where((N.safe_filename(F.col("dat_match")) != "") & (F.col("target_path") != F.col("path"))).select(F.lit("rename").alias("kind"), F.col("id").alias("rom_id"), F.lit(None).cast("long").alias("target_rom_id"), F.col("path").alias("source_path"), "target_path", F.lit("registry name").alias("reason"))


def collisions(renamed: DataFrame, items: DataFrame) -> DataFrame:
    """The plan with renames that can't be done replaced by one collision for each target, or by a deletion where contents are equal."""
    rivals = renamed.groupBy("target_path").agg(F.count("*").alias("rivals"), F.min_by(F.struct("rom_id", "source_path"), "rom_id").alias("first"))
    sources = renamed.select(F.col("source_path").alias("target_path"), F.lit(True).alias("is_source")).distinct()
    there = items.join(renamed.select(F.col("rom_id").alias("id")), "id", "left_anti").select(F.col("path").alias("target_path"), F.col("id").alias("t_id"), F.col("sha1").alias("t_sha"), F.col("is_hack").alias("t_hack"))
    mine = items.select(F.col("id").alias("s_id"), F.col("sha1").alias("s_sha"), F.col("is_hack").alias("s_hack"))
    j = rivals.join(sources, "target_path", "left").join(there, "target_path", "left").join(mine, F.col("first.rom_id") == F.col("s_id"), "left")
    several, moved = F.col("rivals") > 1, F.col("is_source").isNotNull()
    taken = F.col("t_id").isNotNull()
    hack = F.col("s_hack") | F.col("t_hack")
    unknown = F.col("s_sha").isNull() | F.col("t_sha").isNull()
    same = ~several & ~moved & taken & ~unknown & (F.col("s_sha") == F.col("t_sha")) & ~hack
    reason = (
        F.when(several, F.concat(F.col("rivals").cast("string"), F.lit(" renames want this path")))
        .when(moved, "path belongs to another rename")
        .when(taken & unknown, "path is taken; contents aren't known")
        .when(taken & hack, "path is taken by a hack or wanted by one")
        .when(taken & ~same, "path is taken by other content")
    )
    judged = j.select("target_path", F.when(same, "delete_duplicate").when(reason.isNotNull(), "collision").alias("kind"), F.col("first.rom_id").alias("rom_id"), F.col("first.source_path").alias("source_path"), F.when(~several & ~moved, F.col("t_id")).alias("target_rom_id"), F.when(same, "content equals the file that has the name").otherwise(reason).alias("reason")).where("kind IS NOT NULL")
    columns = ["kind", "rom_id", "target_rom_id", "source_path", "target_path", "reason"]
    safe = renamed.join(judged.select("target_path"), "target_path", "left_anti").select(*columns)
    return safe.unionByName(judged.select(*columns))


#: What may be done about a collision, in the order in which it is offered.
CHOICES = ["do_nothing", "delete_source", "replace_target"]
_ACTION = "struct<ordinal:int,kind:string,rom_id:long,source_path:string,target_path:string,reason:string>"


def available_resolutions(plan: DataFrame) -> DataFrame:
    """collision, ordinal, choice: what can be chosen for each collision, by the rows that it knows."""
    source, target = F.col("rom_id").isNotNull(), F.col("target_rom_id").isNotNull()
    offered = F.filter(F.array(F.lit(CHOICES[0]), F.when(source, CHOICES[1]), F.when(source & target, CHOICES[2])), lambda c: c.isNotNull())
    return plan.where("kind = 'collision'").select(F.col("target_path").alias("collision"), F.posexplode(offered).alias("ordinal", "choice"))


def resolutions(plan: DataFrame, choice: str) -> DataFrame:
    """The actions (collision, ordinal, kind, rom_id, source_path, target_path, reason) that a choice makes of each collision: none, one, or two in order.

    do_nothing and unknown choices make none, delete_source deletes the file that should have been renamed, replace_target deletes the file
    at the target path and renames then. A choice that isn't available for a collision makes none of it.
    """

    def action(ordinal, kind, who, source, target, reason):
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("kind"), F.col(who).alias("rom_id"), F.col(source).alias("source_path"), (F.col(target) if target else F.lit(None).cast("string")).alias("target_path"), F.lit(reason).alias("reason"))

    source, both = F.col("rom_id").isNotNull(), F.col("rom_id").isNotNull() & F.col("target_rom_id").isNotNull()
    made = {
        "delete_source": F.when(source, F.array(action(0, "delete_file", "rom_id", "source_path", None, "chosen: delete source"))),
        "replace_target": F.when(both, F.array(action(0, "delete_file", "target_rom_id", "target_path", None, "chosen: delete target before the rename"), action(1, "rename", "rom_id", "source_path", "target_path", "chosen: rename over the deleted target"))),
    }.get(choice, F.lit(None))
    out = plan.where("kind = 'collision'").select(F.col("target_path").alias("collision"), F.explode(made.cast(f"array<{_ACTION}>")).alias("a"))
    return out.select("collision", "a.*")


def alias_merges(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folders named by an alias that isn't canonical, where a canonical folder exists. items: system_id, path; aliases: system_id, alias, canonical."""
    folders = items.groupBy("system_id", N.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"))
    named = folders.withColumn("alias", F.lower(N.base_name(F.col("folder")))).join(aliases, ["system_id", "alias"])
    target = named.where("canonical").groupBy("system_id").agg(F.min("folder").alias("target"))
    return named.where("NOT canonical").join(target, "system_id").select("system_id", "folder", "target", "n_files")


def counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count("*").alias("n_actions"))


def unique_names(wanted: DataFrame, taken: DataFrame, suffix: str = "_imported") -> DataFrame:
    """id, name -> free_name for names or paths that are taken: stem, suffix, and from the second free one on a number (a_imported.sfc, a_imported_2.sfc, ...).

    Dots in folders don't count. Of equal wanted names each gets its own, in the order of ids. taken: name. As many numbers as a name has wanted and taken rows are tried, so the work is
    in proportion to the rows.
    """
    parts = lambda df: df.withColumn("ext", F.regexp_extract("name", r"(?s)[^/](\.[^./]+)$", 1)).withColumn("base", F.left("name", F.length("name") - F.length("ext")))
    game = ["base", "ext"]
    asked = parts(wanted.select("id", "name")).withColumn("k", F.row_number().over(Window.partitionBy(*game).orderBy("id")))
    pattern = rf"(?s)^(.*){suffix}(?:_([1-9][0-9]{{0,8}}))?$"
    used = parts(taken.select("name").distinct()).where(F.col("base").rlike(pattern))
    used = used.select(F.regexp_extract("base", pattern, 1).alias("base"), "ext", F.coalesce(F.regexp_extract("base", pattern, 2).try_cast("int"), F.lit(1)).alias("n")).distinct()
    room = asked.groupBy(*game).agg(F.max("k").alias("w")).join(used.groupBy(*game).agg(F.count("*").alias("t")), game, "left")
    slots = room.select(*game, F.explode(F.sequence(F.lit(1), (F.col("w") + F.coalesce("t", F.lit(0))).cast("int"))).alias("n")).join(used, [*game, "n"], "left_anti")
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy(*game).orderBy("n")))
    named = asked.join(slots, [*game, "k"])
    return named.select("id", "name", F.when(F.col("n") == 1, F.concat("base", F.lit(suffix), "ext")).otherwise(F.concat("base", F.lit(f"{suffix}_"), F.col("n").cast("string"), "ext")).alias("free_name"))


def distinct_keepers(items: DataFrame) -> DataFrame:
    """One item of each content (verified ones first, then by extension, length of name and id); items without a hash are all kept."""
    hashed = F.coalesce("sha1", F.lit("")) != ""
    order = [F.when(F.lower("match_confidence") == "dat_verified", 0).otherwise(1), N.extension_rank(F.lower("extension")), F.length("filename"), F.col("id")]
    group = F.when(hashed, F.concat(F.lit("#"), F.lower("sha1"))).otherwise(F.col("id").cast("string"))
    best = F.min_by(F.struct(*items.columns), F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order))))
    return items.groupBy(group.alias("_group")).agg(best.alias("_kept")).select("_kept.*")


def analyze(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """The whole plan: folder merges, then duplicates, then renames of what isn't deleted, with collisions in their place."""
    dupes = written(duplicates(items), "duplicates")
    moves = written(renames(items, dupes), "renames")
    columns = ["kind", "rom_id", "target_rom_id", "source_path", "target_path", "reason"]
    none = F.lit(None).cast("long")
    merges = alias_merges(items, aliases).select(F.lit("merge_folder").alias("kind"), none.alias("rom_id"), none.alias("target_rom_id"), F.col("folder").alias("source_path"), F.col("target").alias("target_path"), F.lit("folder of an alias").alias("reason"))
    return merges.select(*columns).unionByName(dupes.select(*columns)).unionByName(collisions(moves, items).select(*columns))
