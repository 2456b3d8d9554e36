"""Registered queries of lookups, scopes, candidate sets and summaries, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.catalogue_queries import _A, _ID, _sides, files, table
from shelfspark.operators import catalogue as C
from shelfspark.operators import lookups as U
from shelfspark.operators import rollups as G

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _labels(spark, d, where: str = "true"):
    return table(spark, d, "labels").where(where).select(F.col("doc_id").alias("rom_id"))


_MEMBERS = "mem AS (SELECT l_orderkey AS collection_id, l_partkey % 100 AS rom_id FROM lineitem)"


def _members(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS collection_id", "l_partkey % 100 AS rom_id")


# ---- lookups and scopes


@query(f"WITH {_A} SELECT id, filename FROM a WHERE system_id = 'de'")
def system_files(spark, d):
    return U.of_system(files(spark, d), "de").select("id", "filename")


@query(f"WITH {_A} SELECT replace(path, '/', '\\') AS path, id FROM a WHERE id IN (SELECT doc_id FROM labels) UNION ALL SELECT concat(path, '.old'), NULL FROM a WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def path_lookup(spark, d):
    a = files(spark, d)
    one = U.within(a, _labels(spark, d).withColumnRenamed("rom_id", "id")).select(F.translate("path", "/", "\\").alias("path"))
    two = U.within(a, _labels(spark, d, "toxic = 1").withColumnRenamed("rom_id", "id")).select(F.concat("path", F.lit(".old")).alias("path"))
    return U.by_path(a, one.unionByName(two))


@query(f"WITH {_A}, w AS (SELECT DISTINCT sha1 FROM a WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT DISTINCT item_id::VARCHAR FROM benchmark) SELECT w.sha1, min(a.id) AS id FROM w LEFT JOIN a ON a.sha1 = w.sha1 GROUP BY 1")
def hash_lookup(spark, d):
    a = files(spark, d)
    wanted = U.within(a, _labels(spark, d, "quality = 0").withColumnRenamed("rom_id", "id")).select("sha1").distinct()
    return U.first_of(a, "sha1", wanted.unionByName(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("sha1")).distinct()))


_ROOTED = "c AS (SELECT *, CASE WHEN region = 'Japan' THEN '/old' WHEN region = 'USA' THEN '/lib' END AS library_root FROM a)"


def _rooted(spark, d):
    return files(spark, d).withColumn("library_root", F.when(F.col("region") == "Japan", "/old").when(F.col("region") == "USA", "/lib"))


@query(f"WITH {_A}, {_ROOTED} SELECT count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE library_root IS NOT NULL AND library_root <> '/lib') AS n_other_root FROM c")
def root_counts(spark, d):
    return U.root_counts(_rooted(spark, d), "/lib")


@query(f"WITH {_A} SELECT id, 'Verified' AS state FROM a WHERE contains(filename, '1') AND match_confidence IN ('dat_verified', 'header') AND coalesce(region, '') = '' UNION ALL SELECT id, 'enriched' FROM a WHERE region = 'USA' AND match_confidence = 'fuzzy' AND id IN (SELECT doc_id FROM labels)")
def grid_states(spark, d):
    a = U.flags(files(spark, d), has_metadata=_labels(spark, d))
    one = U.grid(a, text="1", region="None", confidence="Verified").select("id", F.lit("Verified").alias("state"))
    return one.unionByName(U.grid(a, region="USA", confidence="fuzzy", enriched=True).select("id", F.lit("enriched").alias("state")))


@query(f"WITH {_A}, {_MEMBERS} SELECT 'item' AS scope, id FROM a WHERE id = 7 UNION ALL SELECT 'system', id FROM a WHERE system_id = 'fr' UNION ALL SELECT 'collection', rom_id FROM mem WHERE collection_id = 3")
def scope_ids(spark, d):
    a, m = files(spark, d), _members(spark, d)
    named = lambda name, df: df.select(F.lit(name).alias("scope"), "id")
    item = named("item", U.scope(a, m, rom_id=7, system_id="fr"))
    return item.unionByName(named("system", U.scope(a, m, system_id="fr", collection_id=3))).unionByName(named("collection", U.scope(a, m, collection_id=3))).unionByName(named("none", U.scope(a, m)))


@query(f"WITH {_A}, {_MEMBERS} SELECT id, sha1 FROM a WHERE id IN (SELECT rom_id FROM mem WHERE collection_id % 4 = 0)")
def scope_semi(spark, d):
    ids = _members(spark, d).where("collection_id % 4 = 0").select(F.col("rom_id").alias("id"))
    return U.within(files(spark, d), ids).select("id", "sha1")


@query(f"WITH {_A} SELECT id, fuzzy, again FROM (SELECT id, FALSE AS fuzzy, FALSE AS again FROM a WHERE match_confidence = 'dat_verified' AND id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT id, TRUE, FALSE FROM a WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT id, FALSE, TRUE FROM a WHERE match_confidence = 'dat_verified' UNION ALL SELECT id, TRUE, TRUE FROM a)")
def enrichment_switches(spark, d):
    a, m, out = files(spark, d), _labels(spark, d), None
    for fuzzy in (False, True):
        for again in (False, True):
            rows = U.enrichment_candidates(a, m, include_fuzzy=fuzzy, include_enriched=again).select("id", F.lit(fuzzy).alias("fuzzy"), F.lit(again).alias("again"))
            out = rows if out is None else out.unionByName(rows)
    return out


_COVERS = "cov AS (SELECT doc_id AS rom_id, CASE quality WHEN 1 THEN 'Named_Boxarts' ELSE 'Named_Snaps' END AS cover_type FROM labels)"


def _covers(spark, d):
    return table(spark, d, "labels").selectExpr("doc_id AS rom_id", "CASE quality WHEN 1 THEN 'Named_Boxarts' ELSE 'Named_Snaps' END AS cover_type")


@query(f"WITH {_A}, {_COVERS} SELECT id FROM a WHERE fuzzy_key <> '' AND id NOT IN (SELECT rom_id FROM cov WHERE cover_type = 'Named_Boxarts')")
def cover_candidates(spark, d):
    return U.cover_candidates(files(spark, d), _covers(spark, d)).select("id")


@query(f"WITH {_A}, {_COVERS}, {_MEMBERS} SELECT id, id IN (SELECT rom_id FROM cov WHERE cover_type = 'Named_Snaps') AS has_cover, id IN (SELECT rom_id FROM mem WHERE collection_id = 5) AS in_collection FROM a")
def existence_flags(spark, d):
    return U.flags(files(spark, d), has_cover=_covers(spark, d).where("cover_type = 'Named_Snaps'"), in_collection=_members(spark, d).where("collection_id = 5")).select("id", "has_cover", "in_collection")


@query("WITH dst AS (SELECT p_partkey AS id, concat('/mnt/', p_name) AS target_path FROM part WHERE p_size > 20) SELECT w.target_path, min(dst.id) AS id FROM (SELECT DISTINCT concat('/mnt/', p_name) AS target_path FROM part) w LEFT JOIN dst ON dst.target_path = w.target_path GROUP BY 1")
def destination_lookup(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/mnt/"), "p_name").alias("target_path"), "p_size")
    return U.destination_at(part.where("p_size > 20"), part.select("target_path").distinct())


_HASHES = "hs AS (SELECT doc_id AS rom_id, concat('s', doc_id) AS sha1, CAST(1700000000 + quality * 7000 AS DOUBLE) AS hashed_at FROM labels)"


def _hashes(spark, d):
    return table(spark, d, "labels").selectExpr("doc_id AS rom_id", "concat('s', doc_id) AS sha1", "CAST(1700000000 + quality * 7000 AS DOUBLE) AS hashed_at")


def _systems(spark, d):
    return spark.createDataFrame([("en", "smc_512", "English"), ("de", "ines_16", "Deutsch"), ("fr", None, "Français")], "id string, header_rule string, display_name string")


_RULES = "sy AS (SELECT * FROM (VALUES ('en', 'smc_512', 'English'), ('de', 'ines_16', 'Deutsch'), ('fr', NULL, 'Français')) t(id, header_rule, display_name))"


@query(f"WITH {_A}, {_HASHES}, {_RULES} SELECT a.id, header_rule, hs.sha1, hashed_at FROM a LEFT JOIN sy ON sy.id = a.system_id LEFT JOIN hs ON hs.rom_id = a.id")
def hash_state(spark, d):
    return U.with_hashes(files(spark, d), _systems(spark, d), _hashes(spark, d)).select("id", "header_rule", "sha1", "hashed_at")


@query(f"WITH {_A}, {_HASHES}, {_MEMBERS} SELECT a.id FROM a LEFT JOIN hs ON hs.rom_id = a.id WHERE (hashed_at IS NULL OR hashed_at < mtime) AND a.id IN (SELECT rom_id FROM mem)")
def to_hash(spark, d):
    hashed = U.with_hashes(files(spark, d), _systems(spark, d), _hashes(spark, d))
    return U.to_hash(hashed, _members(spark, d).select(F.col("rom_id").alias("id"))).select("id")


@query(f"WITH {_A}, {_HASHES}, {_MEMBERS} SELECT a.id, a.path, hs.sha1 FROM a LEFT JOIN hs ON hs.rom_id = a.id WHERE system_id IN ('en', 'de') AND (region IS NULL OR region IN ('USA', 'Other')) AND a.id IN (SELECT rom_id FROM mem WHERE collection_id < 40)")
def export_candidates_hashed(spark, d):
    picked = U.export_candidates(files(spark, d), systems=["en", "de"], regions=["USA", "Other"], members=_members(spark, d).where("collection_id < 40"))
    return U.with_hashes(picked, _systems(spark, d), _hashes(spark, d)).select("id", "path", "sha1")


@query(f"WITH {_A}, dst AS (SELECT CASE WHEN id % 5 = 0 THEN concat('roms/', system_id, '/GameList.xml') WHEN id % 5 = 1 THEN concat('roms/', id, '.m3u') ELSE concat('roms/', filename) END AS rel_path, system_id, id FROM a), inv AS (SELECT DISTINCT rel_path, CASE WHEN id % 3 = 0 THEN id END AS rom_id FROM dst WHERE id % 5 > 1) SELECT split_part(dst.rel_path, '/', -1) AS filename, dst.system_id, k.id, k.dat_match AS canonical_name, k.region AS title FROM dst LEFT JOIN inv ON inv.rel_path = dst.rel_path LEFT JOIN a k ON k.id = inv.rom_id WHERE dst.id % 5 > 1")
def gamelist_rows(spark, d):
    a = files(spark, d)
    rel = F.expr("CASE WHEN id % 5 = 0 THEN concat('roms/', system_id, '/GameList.xml') WHEN id % 5 = 1 THEN concat('roms/', id, '.m3u') ELSE concat('roms/', filename) END")
    dest = a.select(rel.alias("rel_path"), "system_id", "id")
    inventory = dest.where("id % 5 > 1").select("rel_path", F.when(F.col("id") % 3 == 0, F.col("id")).alias("rom_id"))
    return U.gamelist_rows(dest.drop("id"), inventory, a.select("id", F.col("dat_match").alias("canonical_name"), F.col("region").alias("title")))


@query(f"WITH {_A}, cv AS (SELECT l.doc_id * 2 + k AS id, l.doc_id AS rom_id, concat('/c/', l.doc_id, '_', k, '.PNG') AS local_path, (k = 1 AND quality = 1) AS is_preferred, 100 + toxic AS size_bytes, 50.0 AS mtime FROM labels l, (VALUES (0), (1)) v(k)), b AS (SELECT *, row_number() OVER (PARTITION BY rom_id ORDER BY is_preferred DESC, id) AS n FROM cv), dst AS (SELECT concat(folder, '/media/', regexp_replace(filename, '\\.[^.]*$', ''), '-image.png') AS path, 100 AS size_bytes, CASE WHEN id % 2 = 0 THEN 51.5 ELSE 52.0 END AS mtime FROM a WHERE id % 3 > 0) SELECT a.id, b.local_path AS source_path, concat(a.folder, '/media/', regexp_replace(a.filename, '\\.[^.]*$', ''), '-image.png') AS target_path, CASE WHEN dst.size_bytes = b.size_bytes AND abs(dst.mtime - b.mtime) < 2 THEN 'current' ELSE 'copy' END AS kind FROM a JOIN b ON b.rom_id = a.id AND b.n = 1 LEFT JOIN dst ON dst.path = concat(a.folder, '/media/', regexp_replace(a.filename, '\\.[^.]*$', ''), '-image.png')")
def artwork_plan(spark, d):
    a = files(spark, d)
    two = table(spark, d, "labels").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    covers = two.selectExpr("doc_id * 2 + k AS id", "doc_id AS rom_id", "concat('/c/', doc_id, '_', k, '.PNG') AS local_path", "k = 1 AND quality = 1 AS is_preferred", "100 + toxic AS size_bytes", "CAST(50 AS DOUBLE) AS mtime")
    dest = a.where("id % 3 > 0").selectExpr("concat(folder, '/media/', regexp_replace(filename, '[.][^.]*$', ''), '-image.png') AS path", "100 AS size_bytes", "CASE WHEN id % 2 = 0 THEN 51.5D ELSE 52.0D END AS mtime")
    return U.artwork_plan(a, covers, dest, template="{stem}-image{ext}")


@query("SELECT page_id, page_id % 3 < 2 AS is_image FROM pages")
def image_magic(spark, d):
    head = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode(F.lit("GIF89a"), "utf-8"))
    return table(spark, d, "pages").select("page_id", U.is_image(F.concat(head, F.encode(F.coalesce("html", F.lit("")), "utf-8"))).alias("is_image"))


# ---- roll-ups


@query(f"WITH {_A}, {_RULES} SELECT system_id, display_name, count(*) AS n FROM a JOIN sy ON sy.id = a.system_id GROUP BY 1, 2")
def named_system_counts(spark, d):
    return G.system_counts(files(spark, d), _systems(spark, d))


@query("SELECT count(*) AS n FROM documents")
def total_count(spark, d):
    return files(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {_COVERS} SELECT rom_id, cover_type, count(*) AS n FROM (SELECT * FROM cov UNION ALL SELECT * FROM cov WHERE rom_id % 3 = 0) GROUP BY 1, 2")
def cover_counts(spark, d):
    c = _covers(spark, d)
    return G.cover_counts(c.unionByName(c.where("rom_id % 3 = 0")))


_TWO = "tw AS (SELECT CASE WHEN dest_path IS NULL THEN 'copy_to_dest' WHEN (dest_path IS NOT NULL AND CASE WHEN dest_sha <> '' THEN sha1 <> dest_sha ELSE size_bytes <> dest_size END) THEN 'conflict' ELSE 'identical' END AS kind, coalesce(dest_path, rel_path) AS rel_path, rom_id, CASE WHEN dest_path IS NULL THEN size_bytes WHEN (CASE WHEN dest_sha <> '' THEN sha1 <> dest_sha ELSE size_bytes <> dest_size END) THEN greatest(size_bytes, dest_size) ELSE dest_size END AS size_bytes, mtime, dest_mtime FROM f UNION ALL SELECT 'copy_to_local', rel_path, NULL, size_bytes, NULL, NULL FROM b WHERE rom_id IS NULL)"


@query(f"WITH {_ID}, {_TWO} SELECT kind, count(*) AS n_actions, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM tw GROUP BY 1")
def plan_bytes(spark, d):
    return G.plan_totals(C.sync_plan(*_sides(spark, d), "two_way", policy="newest"))


@query(f"WITH {_ID}, {_TWO} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}, CAST(coalesce(sum(size_bytes) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS bytes_{k}" for k in ("copy_to_dest", "copy_to_local", "delete_dest", "conflict", "identical")) + " FROM tw")
def sync_preview_totals(spark, d):
    return G.sync_preview(C.sync_plan(*_sides(spark, d), "two_way", policy="newest"))


@query(f"WITH {_ID}, {_TWO} SELECT count(*) FILTER (WHERE kind LIKE 'delete%') > 0 AS is_destructive FROM tw")
def two_way_destructive(spark, d):
    return G.is_destructive(C.sync_plan(*_sides(spark, d), "two_way", policy="newest"))


_MAP = "mp AS (SELECT * FROM (VALUES ('en', 'EN', TRUE), ('de', 'DE', FALSE), ('fr', 'FR', TRUE), ('es', '', TRUE)) t(system_id, folder, supported))"


def _mappings(spark):
    return spark.createDataFrame([("en", "EN", True), ("de", "DE", False), ("fr", "FR", True), ("es", "", True)], "system_id string, folder string, supported boolean")


@query(f"WITH {_A}, {_MAP} SELECT a.system_id, mp.folder, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, mp.folder IS NULL AS unsupported FROM a LEFT JOIN mp ON mp.system_id = a.system_id AND supported AND mp.folder <> '' GROUP BY ALL")
def export_preview_folders(spark, d):
    return G.export_folders(files(spark, d), _mappings(spark))


@query(f"WITH {_A}, {_MAP} SELECT mp.folder, filename FROM a JOIN mp ON mp.system_id = a.system_id AND supported AND mp.folder <> ''")
def export_preview_files(spark, d):
    return G.export_files(files(spark, d), _mappings(spark))


_OUT = "CASE size_bytes % 8 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'already_present' WHEN 2 THEN 'refused' WHEN 3 THEN 'error' WHEN 4 THEN 'artwork' WHEN 5 THEN 'duplicate' ELSE 'copied' END"


@query(f"WITH {_A}, o AS (SELECT *, {_OUT} AS outcome FROM a) SELECT system_id, count(*) FILTER (WHERE outcome = 'copied') AS copied, CAST(coalesce(sum(size_bytes) FILTER (WHERE outcome = 'copied'), 0) AS BIGINT) AS bytes_copied, count(*) FILTER (WHERE outcome = 'unsupported') AS skipped_unsupported, count(*) FILTER (WHERE outcome = 'already_present') AS skipped_already_present, count(*) FILTER (WHERE outcome = 'refused') AS skipped_refused, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'artwork') AS artwork_copied, count(*) FILTER (WHERE outcome = 'duplicate') AS skipped_duplicates FROM o GROUP BY 1")
def export_counters(spark, d):
    return G.export_counts(files(spark, d).withColumn("outcome", F.expr(_OUT)))


_KIND = "CASE size_bytes % 6 WHEN 0 THEN 'copy_to_dest' WHEN 1 THEN 'copy_to_local' WHEN 2 THEN 'delete_dest' WHEN 3 THEN 'delete_local' ELSE 'identical' END"


@query(f"WITH {_A}, o AS (SELECT *, {_KIND} AS kind, size_bytes % 7 = 0 AS failed FROM a) SELECT system_id, count(*) FILTER (WHERE kind = 'copy_to_dest' AND NOT failed) AS copied_to_dest, count(*) FILTER (WHERE kind = 'copy_to_local' AND NOT failed) AS copied_to_local, count(*) FILTER (WHERE kind = 'delete_dest' AND NOT failed) AS deleted_dest, count(*) FILTER (WHERE kind = 'delete_local' AND NOT failed) AS deleted_local, count(*) FILTER (WHERE kind = 'identical' AND NOT failed) AS skipped_identical, count(*) FILTER (WHERE failed) AS failed, CAST(coalesce(sum(size_bytes) FILTER (WHERE kind LIKE 'copy%' AND NOT failed), 0) AS BIGINT) AS bytes_copied FROM o GROUP BY 1")
def sync_counters(spark, d):
    return G.sync_counts(files(spark, d).withColumn("kind", F.expr(_KIND)).withColumn("failed", F.col("size_bytes") % 7 == 0))


_STATUS = "CASE size_bytes % 6 WHEN 0 THEN 'dupe_path' WHEN 1 THEN 'dupe_filename' WHEN 2 THEN 'dupe_hash' WHEN 3 THEN 'multi_rom_archive' ELSE 'new' END"


@query(f"WITH {_A}, o AS (SELECT *, {_STATUS} AS status FROM a) SELECT count(*) AS n_files, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in ("new", "dupe_path", "dupe_filename", "dupe_hash", "multi_rom_archive")) + ", CAST(coalesce(sum(size_bytes) FILTER (WHERE status = 'new'), 0) AS BIGINT) AS n_bytes, array_to_string(list_sort(list_distinct(list(system_id) FILTER (WHERE system_id NOT IN ('en', 'fr')))), ',') AS created_systems FROM o")
def import_summary(spark, d):
    plan = files(spark, d).withColumn("status", F.expr(_STATUS)).withColumn("resolution", F.when(F.col("status") == "new", "copy").otherwise("skip"))
    out = G.import_summary(plan, _systems(spark, d).where("id <> 'de'").select(F.col("id").alias("system_id")))
    return out.withColumn("created_systems", F.array_join("created_systems", ","))


@query("SELECT p_brand AS system_id, count(DISTINCT p_name) AS n_crcs FROM part GROUP BY 1")
def dimension_crcs(spark, d):
    return G.distinct_crcs(table(spark, d, "part").select(F.col("p_brand").alias("system_id"), F.col("p_type").alias("dimension"), F.col("p_name").alias("crc")))


@query("SELECT DISTINCT p_brand AS platform FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)")
def unmapped_platforms(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("platform"), "p_size")
    return G.unmapped_platforms(part, part.where("p_size > 45"))


@query(f"WITH {_A} SELECT count(*) AS n_processed, count(*) FILTER (WHERE quality = 1) AS n_metadata, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS n_covers FROM a LEFT JOIN labels l ON l.doc_id = a.id WHERE system_id = 'en'")
def enrichment_stats(spark, d):
    found = table(spark, d, "labels").selectExpr("doc_id AS id", "quality = 1 AS has_metadata", "CAST(toxic AS BIGINT) AS n_covers")
    return G.enrichment_stats(U.of_system(files(spark, d), "en"), found)
