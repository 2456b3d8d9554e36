"""Registered queries of what applied plans, scans and edits make of a snapshot, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.catalogue_queries import _A, _COLL, _DISK, _DUPES, _ID, _MERGES, _aliases, _disk, _sides, files, table
from shelfspark.lookup_queries import _TWO
from shelfspark.operators import catalogue as C
from shelfspark.operators import effects as E
from shelfspark.operators import scan as S
from shelfspark.plans import organize as P
from shelfspark.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- organizing

_PLAN = "pl AS (SELECT 'merge_folder' AS kind, NULL AS rom_id, NULL AS target_rom_id, folder AS source_path, target AS target_path FROM mg UNION ALL SELECT 'delete_duplicate', rom_id, target_rom_id, source_path, target_path FROM dup UNION ALL SELECT 'rename', rom_id, NULL, source_path, target_path FROM ren WHERE target_path NOT IN (SELECT target_path FROM c WHERE kind <> 'rename') UNION ALL SELECT kind, rom_id, CASE WHEN rivals = 1 AND NOT moved THEN t_id END, source_path, target_path FROM c WHERE kind <> 'rename')"
#: Contents at the time of applying: some changed since the plan was made.
_NOW = "now AS (SELECT id, path, CASE WHEN id % 10 = 3 THEN 'changed' ELSE sha1 END AS sha1 FROM a)"
_OUTCOME = f"{_NOW}, {_PLAN}, dl AS (SELECT pl.rom_id FROM pl LEFT JOIN now s ON s.id = pl.rom_id LEFT JOIN now t ON t.path = pl.target_path WHERE kind = 'delete_duplicate' AND (t.id IS NULL OR coalesce(s.sha1 = t.sha1, FALSE))), oc AS (SELECT pl.*, CASE WHEN kind = 'collision' THEN 'skipped' WHEN kind = 'delete_duplicate' THEN CASE WHEN t.id IS NULL OR coalesce(s.sha1 = t.sha1, FALSE) THEN 'applied' ELSE 'failed' END WHEN kind = 'rename' THEN CASE WHEN t.id IS NULL OR t.id IN (SELECT rom_id FROM dl) THEN 'applied' ELSE 'failed' END ELSE CASE WHEN EXISTS (SELECT 1 FROM a x JOIN a y ON y.path = concat(pl.target_path, '/', x.filename) WHERE x.folder = pl.source_path) THEN 'failed' ELSE 'applied' END END AS outcome FROM pl LEFT JOIN now s ON s.id = pl.rom_id LEFT JOIN now t ON t.path = pl.target_path)"


def _outcome(spark, d):
    a = files(spark, d)
    now = a.withColumn("sha1", F.when(F.col("id") % 10 == 3, "changed").otherwise(F.col("sha1")))
    return now, E.organize_outcome(now, written(P.analyze(a, _aliases(spark, d)), "plan"))


@query(f"WITH {_A}, {_DUPES}, {_COLL}, {_MERGES}, {_OUTCOME} SELECT kind, rom_id, source_path, target_path, outcome FROM oc")
def organize_outcome(spark, d):
    return _outcome(spark, d)[1].select("kind", "rom_id", "source_path", "target_path", "outcome")


@query(f"WITH {_A}, {_DUPES}, {_COLL}, {_MERGES}, {_OUTCOME} SELECT a.id, coalesce(r.target_path, CASE WHEN m.target_path IS NOT NULL THEN concat(m.target_path, '/', a.filename) END, a.path) AS path FROM a LEFT JOIN oc r ON r.kind = 'rename' AND r.outcome = 'applied' AND r.rom_id = a.id LEFT JOIN oc m ON m.kind = 'merge_folder' AND m.outcome = 'applied' AND m.source_path = a.folder WHERE a.id NOT IN (SELECT rom_id FROM oc WHERE kind = 'delete_duplicate' AND outcome = 'applied')")
def organize_applied(spark, d):
    now, outcome = _outcome(spark, d)
    return E.organized(now, written(outcome, "outcome")).select("id", "path")


@query("SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN concat('/new/f', doc_id, '.bin') ELSE concat('/lib/f', doc_id, '.sfc') END AS path, CASE WHEN n_chars % 3 = 0 THEN concat('f', doc_id, '.bin') ELSE concat('f', doc_id, '.sfc') END AS filename FROM documents")
def moved_paths(spark, d):
    docs = table(spark, d, "documents")
    items = docs.selectExpr("doc_id AS id", "concat('/lib/f', doc_id, '.sfc') AS path", "concat('f', doc_id, '.sfc') AS filename")
    return E.moved_paths(items, docs.where("n_chars % 3 = 0").selectExpr("doc_id AS id", "concat('/new/f', doc_id, '.bin') AS target_path"))


@query(f"WITH {_A} SELECT id FROM a WHERE region IS NULL OR region <> 'Japan'")
def other_roots_deleted(spark, d):
    root = F.when(F.col("region") == "Japan", "/old").when(F.col("region") == "USA", "/lib")
    return E.without_other_roots(files(spark, d).withColumn("library_root", root), "/lib")[0].select("id")


# ---- scans and registries

_REG = "r AS (SELECT doc_id AS entry_id, sha1(text) AS sha1, left(md5(text), 6) AS weak, n_chars AS size_bytes, concat('Game ', doc_id, ' (USA) [!]') AS game_name, CASE WHEN n_chars % 2 = 0 THEN 'USA' END AS region, CASE WHEN n_chars % 5 = 0 THEN 'Rev 1' END AS revision, n_chars % 3 = 0 AS is_bios FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), s AS (SELECT sha1, min(entry_id) AS e FROM r GROUP BY sha1), w AS (SELECT weak, size_bytes, min(entry_id) AS e FROM r GROUP BY 1, 2 HAVING count(*) = 1)"


@query(f"WITH {_A}, {_REG} SELECT a.id, coalesce(r.game_name, a.dat_match) AS dat_match, CASE WHEN r.entry_id IS NOT NULL THEN concat('Game ', r.entry_id) ELSE 't' END AS title, coalesce(r.game_name, 'c') AS canonical_name, coalesce(r.region, a.region) AS region, r.revision, coalesce(r.is_bios, FALSE) OR a.is_hack AS is_bios, CASE WHEN r.entry_id IS NOT NULL THEN 'dat_verified' ELSE a.match_confidence END AS match_confidence FROM a LEFT JOIN s ON s.sha1 = a.sha1 LEFT JOIN w ON w.weak = a.weak AND w.size_bytes = a.size_bytes LEFT JOIN r ON r.entry_id = coalesce(s.e, w.e)")
def identity_overwrite(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    registry = docs.selectExpr("doc_id AS entry_id", "sha1(text) AS sha1", "left(md5(text), 6) AS weak", "n_chars AS size_bytes", "concat('Game ', doc_id, ' (USA) [!]') AS game_name", "CASE WHEN n_chars % 2 = 0 THEN 'USA' END AS region", "CASE WHEN n_chars % 5 = 0 THEN 'Rev 1' END AS revision", "n_chars % 3 = 0 AS is_bios")
    a = files(spark, d).withColumns({"title": F.lit("t"), "canonical_name": F.lit("c"), "revision": F.lit(None).cast("string"), "is_bios": F.col("is_hack")})
    return E.with_identity(a, S.matched(a, registry)).select("id", "dat_match", "title", "canonical_name", "region", "revision", "is_bios", "match_confidence")


@query("WITH e AS (SELECT p_brand AS dat_file, p_partkey AS entry_id, p_name AS game_name FROM part), n AS (SELECT dat_file, entry_id + 1000000 AS entry_id, game_name FROM e WHERE entry_id % 3 = 0 AND dat_file < 'Brand#20') SELECT * FROM e WHERE dat_file NOT IN (SELECT dat_file FROM n) UNION ALL SELECT * FROM n")
def registry_reload(spark, d):
    e = table(spark, d, "part").selectExpr("p_brand AS dat_file", "p_partkey AS entry_id", "p_name AS game_name")
    return S.load_registry(e, e.where("entry_id % 3 = 0 AND dat_file < 'Brand#20'").withColumn("entry_id", F.col("entry_id") + 1000000))


_TREE = "tr AS (SELECT doc_id, concat(CASE source WHEN 'src0' THEN 'snes' WHEN 'src1' THEN 'Super NES/hacks' WHEN 'src2' THEN 'md' ELSE 'else' END, '/f', doc_id, CASE n_chars % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.srm' WHEN 2 THEN '.MD' ELSE '.zip' END) AS rel_path, CASE source WHEN 'src0' THEN 'snes' WHEN 'src1' THEN 'snes' WHEN 'src2' THEN 'megadrive' END AS system_id, n_chars FROM documents)"
_ACC = "ac AS (SELECT concat('/l/', rel_path) AS path, system_id, n_chars FROM tr WHERE (system_id = 'snes' AND n_chars % 4 IN (0, 3)) OR (system_id = 'megadrive' AND n_chars % 4 IN (2, 3)))"
_OLD = "ol AS (SELECT concat('/l/', rel_path) AS path, coalesce(system_id, 'snes') AS system_id, CAST(1 AS BIGINT) AS size_bytes, FALSE AS missing, 'dat_verified' AS match_confidence FROM tr WHERE doc_id IN (SELECT doc_id FROM labels))"


def _scan(spark, d, scope=None):
    docs = table(spark, d, "documents")
    rel = "concat(CASE source WHEN 'src0' THEN 'snes' WHEN 'src1' THEN 'Super NES/hacks' WHEN 'src2' THEN 'md' ELSE 'else' END, '/f', doc_id, CASE n_chars % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.srm' WHEN 2 THEN '.MD' ELSE '.zip' END)"
    tree = docs.selectExpr("doc_id", f"{rel} AS rel_path", "n_chars", "source")
    listing = tree.select(F.concat(F.lit("/l/"), "rel_path").alias("path"), "rel_path", F.substring_index("rel_path", "/", -1).alias("filename"), F.col("n_chars").alias("size_bytes"), F.lit(0.0).alias("mtime"))
    systems = spark.createDataFrame([("snes", 1, ["snes", "super nes"], [".sfc", ".smc"]), ("megadrive", 2, ["md", "genesis"], [".md"])], "id string, ord int, folder_aliases array<string>, extensions array<string>")
    system = F.when(F.col("source").isin("src0", "src1"), "snes").when(F.col("source") == "src2", "megadrive").otherwise("snes")
    known = tree.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    old = known.select(F.concat(F.lit("/l/"), "rel_path").alias("path"), system.alias("system_id"), F.lit(1).cast("long").alias("size_bytes"), F.lit(False).alias("missing"), F.lit("dat_verified").alias("match_confidence"))
    return S.scan_library(old, listing, systems, "/l", scope=scope)


@query(f"WITH {_TREE}, {_ACC}, {_OLD} SELECT coalesce(ac.path, ol.path) AS path, coalesce(ac.system_id, ol.system_id) AS system_id, coalesce(ac.n_chars, ol.size_bytes) AS size_bytes, ac.path IS NULL AS missing, coalesce(ol.match_confidence, 'fuzzy') AS match_confidence FROM ol FULL JOIN ac ON ac.path = ol.path")
def library_scan(spark, d):
    return _scan(spark, d)


@query(f"WITH {_TREE}, {_ACC}, {_OLD} SELECT coalesce(x.path, ol.path) AS path, coalesce(x.system_id, ol.system_id) AS system_id, coalesce(x.n_chars, ol.size_bytes) AS size_bytes, x.path IS NULL AND ol.system_id = 'megadrive' AS missing, coalesce(ol.match_confidence, 'fuzzy') AS match_confidence FROM ol FULL JOIN (SELECT * FROM ac WHERE system_id = 'megadrive') x ON x.path = ol.path")
def library_scan_scoped(spark, d):
    return _scan(spark, d, "megadrive")


# ---- scrub, sync, import

_SCRUB = "c AS (SELECT *, CASE WHEN region = 'Japan' THEN '/old/' WHEN region = 'USA' THEN '/lib/' END AS library_root FROM a), sc AS (SELECT c.*, disk_size, disk_mtime, coalesce(CASE WHEN library_root = '/old/' THEN 'outside_root' WHEN disk_size IS NULL AND NOT missing THEN 'missing_unflagged' WHEN disk_size IS NOT NULL AND missing THEN 'flagged_but_present' WHEN disk_size IS NOT NULL AND (size_bytes <> disk_size OR abs(mtime - disk_mtime) >= 2) THEN 'drift' END, '') AS status FROM c LEFT JOIN disk ON disk.path = c.path)"


def _scrubbed(spark, d):
    a = files(spark, d).withColumn("library_root", F.when(F.col("region") == "Japan", "/old/").when(F.col("region") == "USA", "/lib/"))
    hashes = a.select(F.col("id").alias("rom_id"), "sha1")
    return E.scrubbed(a, hashes, C.scrub(a, _disk(spark, d), "/lib"))


@query(f"WITH {_A}, {_DISK}, {_SCRUB} SELECT id, CASE status WHEN 'missing_unflagged' THEN TRUE WHEN 'flagged_but_present' THEN FALSE ELSE missing END AS missing, CASE status WHEN 'drift' THEN disk_size ELSE size_bytes END AS size_bytes, CASE status WHEN 'drift' THEN disk_mtime ELSE mtime END AS mtime FROM sc WHERE status <> 'outside_root'")
def scrub_applied(spark, d):
    return _scrubbed(spark, d)[0].select("id", "missing", "size_bytes", "mtime")


@query(f"WITH {_A}, {_DISK}, {_SCRUB} SELECT id AS rom_id, sha1 FROM sc WHERE status NOT IN ('outside_root', 'drift')")
def scrub_hashes(spark, d):
    return _scrubbed(spark, d)[1].select("rom_id", "sha1")


_RES = "CASE WHEN mtime > dest_mtime THEN 'local' WHEN dest_mtime > mtime THEN 'dest' ELSE 'skip' END"


def _synced(spark, d):
    local, dest = _sides(spark, d)
    return E.synced(dest, written(C.sync_plan(local, dest, "two_way", policy="newest"), "sync"))


@query(f"WITH {_ID}, {_TWO}, cp AS (SELECT rel_path, arg_min(size_bytes, rom_id) AS size_bytes, min(rom_id) AS rom_id FROM tw WHERE kind = 'copy_to_dest' OR (kind = 'conflict' AND {_RES} = 'local') GROUP BY 1) SELECT rel_path, size_bytes, NULL AS rom_id FROM e WHERE rel_path NOT IN (SELECT rel_path FROM cp) UNION ALL SELECT * FROM cp")
def sync_inventory(spark, d):
    return _synced(spark, d)[0]


@query(f"WITH {_ID}, {_TWO} SELECT rel_path, size_bytes FROM tw WHERE kind = 'copy_to_local' OR (kind = 'conflict' AND {_RES} = 'dest')")
def sync_fetched(spark, d):
    return _synced(spark, d)[1]


# ---- covers, destinations, history, settings


@query("WITH cv AS (SELECT doc_id AS id, doc_id AS rom_id, 'Named_Boxarts' AS cover_type, concat('/c/', quality, toxic, '.png') AS local_path, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS is_preferred FROM labels), dn AS (SELECT doc_id AS rom_id, min(doc_id) OVER () AS donor_id FROM labels), nw AS (SELECT DISTINCT dn.rom_id, c.cover_type, c.local_path FROM dn JOIN cv c ON c.rom_id = dn.donor_id WHERE dn.rom_id <> dn.donor_id AND NOT EXISTS (SELECT 1 FROM cv o WHERE o.rom_id = dn.rom_id AND o.local_path = c.local_path)), al AS (SELECT * FROM cv UNION ALL SELECT NULL, rom_id, cover_type, local_path, 0 FROM nw) SELECT id, rom_id, cover_type, local_path, CASE WHEN max(is_preferred) OVER g = 0 AND row_number() OVER (PARTITION BY rom_id, cover_type ORDER BY id NULLS LAST, local_path) = 1 THEN 1 ELSE is_preferred END AS is_preferred FROM al WINDOW g AS (PARTITION BY rom_id, cover_type)")
def covers_copied(spark, d):
    labels = table(spark, d, "labels")
    covers = labels.selectExpr("doc_id AS id", "doc_id AS rom_id", "'Named_Boxarts' AS cover_type", "concat('/c/', quality, toxic, '.png') AS local_path", "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS is_preferred")
    least = labels.agg(F.min("doc_id").alias("donor_id"), F.lit(1).alias("one"))
    donors = labels.select(F.col("doc_id").alias("rom_id"), F.lit(1).alias("one")).join(F.broadcast(least), "one").drop("one")
    return E.copied_covers(covers, donors)


_INV = "inv AS (SELECT doc_id % 4 AS dest_id, path AS rel_path, a.size_bytes, a.mtime, a.sha1, a.id AS rom_id FROM a JOIN documents ON doc_id = a.id)"


def _inventory(spark, d):
    return files(spark, d).select((F.col("id") % 4).alias("dest_id"), F.col("path").alias("rel_path"), "size_bytes", "mtime", "sha1", F.col("id").alias("rom_id"))


def _destinations(spark):
    return spark.createDataFrame([(0, "s0"), (1, "old"), (2, None), (3, "")], "id long, signature string")


@query(f"WITH {_A}, {_DISK} SELECT a.id % 4 AS dest_id, a.path AS rel_path, disk_size AS size_bytes, CASE WHEN a.id % 4 <> 1 AND disk_size = a.size_bytes AND disk_mtime = a.mtime THEN a.sha1 END AS sha1, CASE WHEN a.id % 4 <> 1 AND disk_size = a.size_bytes AND disk_mtime = a.mtime THEN a.id END AS rom_id FROM disk JOIN a ON a.path = disk.path")
def destination_rescan(spark, d):
    present = _inventory(spark, d).select("dest_id", "rel_path").join(_disk(spark, d).select(F.col("path").alias("rel_path"), F.col("disk_size").alias("size_bytes"), F.col("disk_mtime").alias("mtime")), "rel_path")
    now = spark.createDataFrame([(k, f"s{k}") for k in range(4)], "dest_id long, signature string")
    return E.rescanned(_destinations(spark), _inventory(spark, d), present, now).drop("mtime")


@query(f"WITH {_A}, {_INV} SELECT dest_id, rel_path FROM inv WHERE dest_id <> 2")
def cache_forgotten(spark, d):
    return E.without_cache(_inventory(spark, d), _destinations(spark), 2)[0].select("dest_id", "rel_path")


@query("WITH h AS (SELECT o_orderkey AS scan_id, o_orderstatus AS status, o_custkey AS found FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 5 = 0 THEN 'done' END AS status FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(n.scan_id, h.scan_id) AS scan_id, coalesce(n.status, h.status) AS status, h.found FROM h FULL JOIN n ON n.scan_id = h.scan_id")
def scan_history(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 > 0").selectExpr("o_orderkey AS scan_id", "o_orderstatus AS status", "o_custkey AS found")
    return E.with_history(old, orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS scan_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'done' END AS status"))


@query("WITH c AS (SELECT DISTINCT p_name AS key, 'old' AS value FROM part WHERE p_size > 30), n AS (SELECT p_name AS key, min(p_brand) AS value FROM part WHERE p_size < 10 GROUP BY 1), s AS (SELECT * FROM c WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n) SELECT * FROM s UNION ALL SELECT DISTINCT p_name, 'default' FROM part WHERE p_name NOT IN (SELECT key FROM s)")
def settings(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_size > 30").select(F.col("p_name").alias("key"), F.lit("old").alias("value")).distinct()
    return E.configured(old, part.where("p_size < 10").select(F.col("p_name").alias("key"), F.col("p_brand").alias("value")), part.select(F.col("p_name").alias("key"), F.lit("default").alias("value")))
