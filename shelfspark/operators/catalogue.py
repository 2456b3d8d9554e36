"""Snapshot operators: merge, sweep, cascade, scrub, inventory, sync, import, enrichment and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.resolve import first_wins, tier_ladder

KEEP_OLD = ["header_title", "dat_match", "library_root", "title", "canonical_name", "region", "revision"]


def upsert(old: DataFrame, new: DataFrame, *, key: str = "path", keep_old: list[str] = KEEP_OLD, rank: str = "match_confidence", protect_verified: bool = False) -> DataFrame:
    """The next snapshot: new values win, but null ones leave the old value of ``keep_old``; confidence never falls; matched rows aren't missing.

    protect_verified: identity fields of rows verified by a registry stay (the merge itself overwrites them).
    """
    o, n = old.alias("o"), new.alias("n")
    seen = F.col(f"n.{key}").isNotNull()
    out: list[Column] = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        if c not in new.columns:
            value = F.col(f"o.{c}")
        elif c == rank:
            value = F.when(seen & (F.col(f"o.{key}").isNull() | (N.confidence_rank(F.col(f"n.{c}")) >= N.confidence_rank(F.col(f"o.{c}")))), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        elif c in keep_old:
            value = F.coalesce(f"n.{c}", f"o.{c}")
            if protect_verified:
                value = F.when(F.col(f"o.{rank}") == "dat_verified", F.coalesce(f"o.{c}", f"n.{c}")).otherwise(value)
        else:
            value = F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append((F.when(seen, F.lit(False)).otherwise(value) if c == "missing" else value).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)


def sweep_missing(catalogue: DataFrame, visited: DataFrame, key: str = "path") -> DataFrame:
    """Catalogue rows that a scan didn't visit."""
    return catalogue.join(visited.select(key).distinct(), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of old rows with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def cascade(gone: DataFrame, dependents: dict[str, DataFrame], key: str = "rom_id") -> dict[str, DataFrame]:
    """Each dependent table without the rows of removed items."""
    ids = gone.select(key).distinct()
    return {name: t.join(ids, key, "left_anti") for name, t in dependents.items()}


def scrub(catalogue: DataFrame, disk: DataFrame, root: str) -> DataFrame:
    """The mismatch of each catalogue row with the disk; rows that match or can't be read are left out. disk: path, disk_size, disk_mtime, readable."""
    own = F.rtrim(F.regexp_replace("library_root", r"[/\\]+$", ""))
    joined = catalogue.join(disk, "path", "left")
    there = F.col("disk_size").isNotNull()
    status = (
        F.when(F.col("library_root").isNotNull() & (F.col("library_root") != "") & (own != root.rstrip("\\/").rstrip()), "outside_root")
        .when(F.col("readable") == F.lit(False), F.lit(None))
        .when(~there & ~F.col("missing"), "missing_unflagged")
        .when(there & F.col("missing"), "flagged_but_present")
        .when(there & N.drifted(F.col("size_bytes"), F.col("disk_size"), F.col("mtime"), F.col("disk_mtime")), "drift")
    )
    return joined.withColumn("status", status).where("status IS NOT NULL")


def inventory_refresh(cached: DataFrame, present: DataFrame) -> DataFrame:
    """The next inventory: rows whose path, size and mtime are as before keep sha1 and rom_id, drifted ones lose them, absent ones go."""
    c = cached.select("rel_path", F.col("size_bytes").alias("c_size"), F.col("mtime").alias("c_mtime"), "sha1", "rom_id")
    joined = present.join(c, "rel_path", "left")
    same = (F.col("size_bytes") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime"))
    return joined.select("rel_path", "size_bytes", "mtime", F.when(same, F.col("sha1")).alias("sha1"), F.when(same, F.col("rom_id")).alias("rom_id"), F.coalesce(same, F.lit(False)).alias("reused"))


def signature(paths: DataFrame, group: str, path: str, n: int = 32) -> DataFrame:
    """SHA-1 of the first n paths of each group in order, joined by NUL. The limit applies before the shuffle too, so no group is held whole."""
    first = paths.withColumn("_place", F.dense_rank().over(Window.partitionBy(group).orderBy(path))).where(F.col("_place") <= n)
    return first.groupBy(group).agg(F.sha1(F.array_join(F.sort_array(F.collect_set(path)), "\0")).alias("signature"))


def conflict_resolution(policy: str, local_time: Column, dest_time: Column) -> Column:
    if policy == "newest":
        return F.when(local_time > dest_time, "local").when(dest_time > local_time, "dest").otherwise("skip")
    return F.lit(policy if policy in ("skip", "local", "dest", "prompt") else "skip")


def bytes_differ(local_sha: Column, dest_sha: Column, local_size: Column, dest_size: Column) -> Column:
    both = (F.coalesce(local_sha, F.lit("")) != "") & (F.coalesce(dest_sha, F.lit("")) != "")
    return F.when(both, F.lower(local_sha) != F.lower(dest_sha)).otherwise(local_size != dest_size)


def _identity(local: DataFrame, dest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local with the destination file at its path or of its identity, destination with its local file by sha1, path, identity)"""
    by_key = first_wins(dest.where("fuzzy_key <> ''").select("fuzzy_key", "region", "system_id", F.col("rel_path").alias("k_path"), F.col("size_bytes").alias("k_size"), F.col("sha1").alias("k_sha"), F.col("mtime").alias("k_mtime")), ["fuzzy_key", "region", "system_id"], [F.col("k_path")])
    at_path = dest.select("rel_path", F.col("size_bytes").alias("p_size"), F.col("sha1").alias("p_sha"), F.col("mtime").alias("p_mtime"))
    out = local.join(at_path, "rel_path", "left").join(by_key, ["fuzzy_key", "region", "system_id"], "left")
    hit = F.col("p_size").isNotNull()
    pick = lambda a, b: F.when(hit, F.col(a)).otherwise(F.col(b))
    forward = out.select(*local.columns, hit.alias("at_path"), F.when(hit, F.col("rel_path")).otherwise(F.col("k_path")).alias("dest_path"), pick("p_size", "k_size").alias("dest_size"), pick("p_sha", "k_sha").alias("dest_sha"), pick("p_mtime", "k_mtime").alias("dest_mtime"))
    order = [F.col("rom_id")]
    sides = [
        (first_wins(local.select(F.lower("sha1").alias("sha1"), "rom_id"), ["sha1"], order), ["sha1"]),
        (first_wins(local.select("rel_path", "rom_id"), ["rel_path"], [-F.col("rom_id")]), ["rel_path"]),
        (first_wins(local.where("fuzzy_key <> ''").select("fuzzy_key", "region", "system_id", "rom_id"), ["fuzzy_key", "region", "system_id"], order), ["fuzzy_key", "region", "system_id"]),
    ]
    back = tier_ladder(dest.drop("rom_id").withColumn("sha1", F.lower("sha1")), sides, ["rom_id"])
    return forward, back


def sync_plan(local: DataFrame, dest: DataFrame, mode: str, *, base_path: str = "", policy: str = "skip") -> DataFrame:
    """Actions kind, rel_path, rom_id, size_bytes, resolution of push_merge, push_mirror, push_wipe, pull or two_way.

    local and dest: rom_id, rel_path, size_bytes, mtime, sha1, fuzzy_key, region, system_id.
    """
    if mode == "push_wipe":  # nothing is left on a wiped destination
        gone = dest.where(~N.is_sidecar(F.col("rel_path")))
        if base_path:
            gone = gone.where(F.col("rel_path").startswith(base_path.rstrip("/") + "/"))
        copies = local.select(F.lit("copy_to_dest").alias("kind"), "rel_path", "rom_id", "size_bytes", F.lit(None).cast("string").alias("resolution"))
        return copies.unionByName(gone.select(F.lit("delete_dest").alias("kind"), "rel_path", F.lit(None).cast("long").alias("rom_id"), "size_bytes", F.lit(None).cast("string").alias("resolution")))
    forward, back = _identity(local, dest)
    none = F.lit(None).cast("string").alias("resolution")
    there = F.col("dest_path").isNotNull()
    if mode == "two_way":
        differ = there & bytes_differ(F.col("sha1"), F.col("dest_sha"), F.col("size_bytes"), F.col("dest_size"))
        kind = F.when(~there, "copy_to_dest").when(differ, "conflict").otherwise("identical")
        size = F.when(~there, F.col("size_bytes")).when(differ, F.greatest("size_bytes", "dest_size")).otherwise(F.col("dest_size"))
        ahead = forward.select(kind.alias("kind"), F.coalesce("dest_path", "rel_path").alias("rel_path"), "rom_id", size.alias("size_bytes"), F.when(differ, conflict_resolution(policy, F.col("mtime"), F.col("dest_mtime"))).alias("resolution"))
    else:
        ahead = forward.select(F.when(there, "identical").otherwise("copy_to_dest").alias("kind"), F.coalesce("dest_path", "rel_path").alias("rel_path"), "rom_id", F.coalesce("dest_size", "size_bytes").alias("size_bytes"), none)
    loose = back.where(~N.is_sidecar(F.col("rel_path")))
    if mode == "pull":
        kind = F.when(F.col("rom_id").isNull(), "copy_to_local").otherwise("identical")
        return loose.select(kind.alias("kind"), "rel_path", "rom_id", "size_bytes", none)
    if mode == "push_merge":
        return ahead
    if mode == "two_way":
        return ahead.unionByName(loose.where("rom_id IS NULL").select(F.lit("copy_to_local").alias("kind"), "rel_path", "rom_id", "size_bytes", none))
    if mode == "push_mirror":
        gone = loose.where("rom_id IS NULL")
        if base_path:
            gone = gone.where(F.col("rel_path").startswith(base_path.rstrip("/") + "/"))
        return ahead.unionByName(gone.select(F.lit("delete_dest").alias("kind"), "rel_path", "rom_id", "size_bytes", none))
    raise ValueError(mode)


def import_status(staged: DataFrame, catalogue: DataFrame, disk: DataFrame, *, by_content: bool = True, default: str = "copy") -> DataFrame:
    """staged with status, resolution and the id of the catalogue row it collides with.

    In this order: multi_rom_archive (column is_multi, if there is one); dupe_path: the target path is catalogued, or a file of equal size is
    there; dupe_filename: a file of another size is there; dupe_hash: equal content is catalogued (by_content, and only for files of a system
    that takes their extension: column accepts, if there is one); new. All but new are skipped. staged: target_path, size_bytes, sha1, system_id; catalogue: id, path, sha1; disk: path, size_bytes.
    """
    by_path = catalogue.groupBy(F.col("path").alias("target_path")).agg(F.min("id").alias("path_id"))
    on_disk = disk.select(F.col("path").alias("target_path"), F.col("size_bytes").alias("disk_size"), F.lit(True).alias("there"))
    by_hash = first_wins(catalogue.select("sha1", F.col("id").alias("hash_id")), ["sha1"], [F.col("hash_id")])
    joined = staged.join(by_path, "target_path", "left").join(on_disk, "target_path", "left").join(by_hash, "sha1", "left")
    multi = F.col("is_multi") if "is_multi" in staged.columns else F.lit(False)
    there = F.col("there").isNotNull()
    same_path = F.col("path_id").isNotNull() | (there & F.coalesce(F.col("disk_size") == F.col("size_bytes"), F.lit(False)))
    accepts = F.col("accepts") if "accepts" in staged.columns else F.lit(True)
    content = F.lit(by_content) & accepts & F.col("system_id").isNotNull() & F.col("hash_id").isNotNull()
    status = F.when(multi, "multi_rom_archive").when(same_path, "dupe_path").when(there, "dupe_filename").when(content, "dupe_hash").otherwise("new")
    with_status = joined.withColumn("status", status)
    other = F.when(F.col("status") == "dupe_path", F.col("path_id")).when(F.col("status") == "dupe_hash", F.col("hash_id"))
    return with_status.select(*staged.columns, "status", F.when(F.col("status") == "new", default).otherwise("skip").alias("resolution"), other.alias("collides_with"))


def registry_match(items: DataFrame, registry: DataFrame) -> DataFrame:
    """entry_id and match_tier of each item: by sha1 (least entry), then by (weak key, size) if just one entry has it."""
    strong = first_wins(registry.select("sha1", "entry_id"), ["sha1"], [F.col("entry_id")])
    weak = registry.where("weak IS NOT NULL").groupBy("weak", "size_bytes").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return tier_ladder(items, [(strong, ["sha1"]), (weak, ["weak", "size_bytes"])], ["entry_id"])


def sibling_donor(targets: DataFrame, donors: DataFrame, keys: list[list[str]], key: str = "id") -> DataFrame:
    """donor_id and match_tier: the least donor with the first keys that have one. A target is no donor of its own (donors and targets don't overlap)."""
    tiers = [(first_wins(donors.select(*k, F.col(key).alias("donor_id")), k, [F.col("donor_id")]), k) for k in keys]
    return tier_ladder(targets, tiers, ["donor_id"])


def totals(df: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of each key and a row for all of them (key null, is_total 1)."""
    return df.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *(c.alias(n) for n, c in measures.items()))


def playlists(files: DataFrame, group: list[str]) -> DataFrame:
    """A playlist for each game of two discs or more. filename; group: where the file is."""
    base = files.where(N.is_multi_disc(F.col("filename"))).withColumn("base", N.disc_base(F.col("filename")))
    out = base.groupBy(*group, "base").agg(F.sort_array(F.collect_list("filename")).alias("f"))
    return out.where(F.size("f") >= 2).select(*group, "base", F.size("f").alias("n_discs"), F.array_join("f", "\n").alias("content"))
