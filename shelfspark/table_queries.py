"""Registered queries of edits, ordered pages, kept plans and the registry of systems, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.catalogue_queries import _A, files, table
from shelfspark.operators import destinations as D
from shelfspark.operators import pages as G
from shelfspark.operators import systems as Y
from shelfspark.plans import saved as S
from shelfspark.sources import profiles
from shelfspark.sources import sinks as K
from shelfspark.sources.shared import shared_dir, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- pages

_NAMED = f"{_A}, t AS (SELECT id, filename, system_id, region, size_bytes, CASE WHEN id % 3 > 0 THEN left(fuzzy_key, 1) END AS title FROM a)"
_ORDERS = {"name": "filename, id", "system and title": "system_id NULLS FIRST, title NULLS FIRST, id", "size": "size_bytes DESC NULLS LAST, id", "region": "region DESC NULLS LAST, id"}


@query(f"WITH {_NAMED}, n AS ({' UNION ALL '.join(f"SELECT '{k}' AS listing, id, row_number() OVER (ORDER BY {o}) AS place FROM t" for k, o in _ORDERS.items())}) SELECT listing, id, CAST(CASE WHEN place > 40 THEN 3 WHEN place > 20 THEN 2 ELSE 1 END AS INTEGER) AS page FROM n WHERE place <= 60")
def ordered_pages(spark, d):
    """Three pages of 20 rows of each of four listings, each asked for by the last key of the one before."""
    rows = files(spark, d).select("id", "filename", "system_id", "region", "size_bytes", F.when(F.col("id") % 3 > 0, F.left("fuzzy_key", F.lit(1))).alias("title"))
    out = None
    for name, order in {"name": G.BY_NAME, "system and title": G.BY_SYSTEM_TITLE, "size": G.LARGEST_FIRST, "region": [("region", True), ("id", False)]}.items():
        key = None
        for k in (1, 2, 3):
            page = written(G.page(rows, order, 20, key), "page")
            key = G.last_key(page, order) or key
            own = page.select(F.lit(name).alias("listing"), "id", F.lit(k).alias("page"))
            out = own if out is None else out.unionByName(own)
    return out


# ---- edits

_DESTS = "d AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('/mnt/', s_name) END AS target_path, concat('p', s_nationkey) AS profile_id, CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS DOUBLE) AS last_synced_at FROM supplier)"


def _destinations(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN concat('/mnt/', s_name) END AS target_path", "concat('p', s_nationkey) AS profile_id", "CAST(NULL AS STRING) AS signature", "CAST(NULL AS DOUBLE) AS last_synced_at")


@query(
    f"""WITH {_DESTS}, e AS (SELECT ps % 40 AS id, seq, name, target_path FROM (SELECT c_custkey AS ps, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN concat('/mnt/', c_custkey) END AS target_path FROM customer)),
    n AS (SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(target_path, seq) FILTER (target_path IS NOT NULL) AS target_path FROM e GROUP BY 1)
    SELECT d.id, coalesce(n.name, d.name) AS name, coalesce(n.target_path, d.target_path) AS target_path, d.profile_id, CASE WHEN d.id % 4 = 1 THEN 7.5::DOUBLE END AS last_synced_at FROM d LEFT JOIN n ON n.id = d.id WHERE d.id % 7 <> 0"""
)
def destination_edits(spark, d):
    """Destinations after many edits of some of their fields, stamps of an own clock and deletions."""
    old = _destinations(spark, d)
    edits = table(spark, d, "customer").selectExpr("c_custkey % 40 AS id", "c_custkey AS seq", "CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name", "CASE WHEN c_custkey % 5 = 0 THEN concat('/mnt/', c_custkey) END AS target_path", "CAST(NULL AS STRING) AS profile_id")
    now = D.stamped(D.edited(old, edits), old.where("id % 4 = 1"), "last_synced_at", F.lit(7.5))
    none = spark.createDataFrame([], "dest_id long, rel_path string")
    return D.deleted(now, none, old.where("id % 7 = 0"))[0].drop("signature")


@query(
    f"""WITH {_A}, i AS (SELECT id % 4 AS dest_id, path AS rel_path, size_bytes, sha1, id AS rom_id FROM a WHERE id % 3 > 0), n AS (SELECT id % 4 AS dest_id, path AS rel_path, size_bytes + 1 AS size_bytes, CASE WHEN id % 5 = 0 THEN 'new' END AS sha1, CASE WHEN id % 7 = 0 THEN -1 END AS rom_id FROM a WHERE id % 2 = 0)
    SELECT coalesce(i.dest_id, n.dest_id) AS dest_id, coalesce(i.rel_path, n.rel_path) AS rel_path, coalesce(n.size_bytes, i.size_bytes) AS size_bytes, coalesce(n.sha1, i.sha1) AS sha1, coalesce(n.rom_id, i.rom_id) AS rom_id, CASE WHEN n.rel_path IS NULL THEN 'then' ELSE 'now' END AS last_seen_at FROM i FULL JOIN n ON n.dest_id = i.dest_id AND n.rel_path = i.rel_path"""
)
def inventory_upsert(spark, d):
    a = files(spark, d)
    key = [(F.col("id") % 4).alias("dest_id"), F.col("path").alias("rel_path")]
    old = a.where("id % 3 > 0").select(*key, "size_bytes", "mtime", "sha1", F.col("id").alias("rom_id"), F.lit("then").alias("last_seen_at"))
    seen = a.where("id % 2 = 0").select(*key, (F.col("size_bytes") + 1).alias("size_bytes"), "mtime", F.when(F.col("id") % 5 == 0, "new").alias("sha1"), F.when(F.col("id") % 7 == 0, -1).alias("rom_id"))
    return D.remembered(old, seen, F.lit("now")).drop("mtime")


# ---- the registry of systems


@query(
    """WITH l AS (SELECT concat('sys', p_partkey) AS id, p_name, p_size FROM part WHERE p_size <= 40), t AS (SELECT concat('sys', p_partkey) AS id FROM part WHERE p_size > 25)
    SELECT 'kept' AS kind, id, 'old' AS detail FROM t UNION ALL SELECT 'added', id, p_name FROM l WHERE id NOT IN (SELECT id FROM t)
    UNION ALL SELECT 'orphan', concat('sys', p_partkey), 'old' FROM part WHERE p_size > 40
    UNION ALL SELECT 'refused', concat('sys', p_partkey), 'repeated_id' FROM part, (VALUES (1), (2)) v(n) WHERE p_size <= 5 UNION ALL SELECT 'refused', concat('sys', p_partkey), 'extension' FROM part WHERE p_size = 40"""
)
def registry_refresh(spark, d):
    """A reload of good files seeds the table; one with repeated ids and a bad extension changes nothing and is reported."""
    part = table(spark, d, "part")
    entry = "concat('  - id: sys', p_partkey, '\\n    display_name: \"', p_name, '\"\\n    short_name: S\\n    extensions: [', ext, ']\\n') AS entry"

    def load(rows, name):
        root = shared_dir(spark, name).removeprefix("file://").removeprefix("file:")
        K.write_books(rows.selectExpr("book", entry), root, "systems:\n")  # a hundred entries a file
        return profiles.registry_systems(spark, root)

    own = part.selectExpr("p_partkey", "p_name", "p_size", "p_partkey div 100 AS book", "concat('.x', p_size) AS ext")
    current = part.selectExpr("concat('sys', p_partkey) AS id", "'old' AS display_name", "p_size").where("p_size > 25").drop("p_size")
    registry, none = Y.reload(current, load(own.where("p_size <= 40"), "systems"))
    bad = own.where("p_size <= 5").unionByName(own.where("p_size <= 5").withColumn("book", F.col("book") + 1000000)).unionByName(own.where("p_size = 40").withColumn("ext", F.lit("nodot")))
    registry, problems = Y.reload(registry, load(bad, "bad-systems"))
    after, added = Y.seed(current, registry)
    kind = F.when(F.col("display_name") == "old", "kept").otherwise("added").alias("kind")
    orphans = Y.orphans(current.select(F.col("id").alias("system_id"), F.col("display_name").alias("detail")), registry)
    return after.select(kind, "id", F.col("display_name").alias("detail")).unionByName(orphans.select(F.lit("orphan").alias("kind"), F.col("system_id").alias("id"), "detail")).unionByName(problems.select(F.lit("refused").alias("kind"), "id", F.col("problem").alias("detail"))).unionByName(none.select(F.lit("problem").alias("kind"), "id", F.col("problem").alias("detail")))


@query("SELECT DISTINCT lower(replace(x, '#', '.')) AS extension FROM (SELECT p_brand AS x FROM part UNION ALL SELECT concat('.', p_type) FROM part)")
def known_extensions(spark, d):
    systems = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.translate("p_brand", "#", "."), F.concat(F.lit("."), "p_type")).alias("extensions"))
    return Y.known_extensions(systems)


# ---- kept plans


@query(
    f"""WITH {_A}, n AS (SELECT system_id, count(*) AS n FROM a GROUP BY 1), p AS (SELECT * FROM (VALUES (1, 1, 'en', 'applied'), (2, 2, 'de', 'pending'), (3, 1, 'fr', 'cancelled'), (4, 1, 'en', 'pending'), (5, 2, 'de', 'partial')) v(plan_id, dest_id, s, status))
    SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(dest_id AS BIGINT) AS dest_id, status, concat('{{"copy":', n, '}}') AS summary, CAST(row_number() OVER (PARTITION BY dest_id ORDER BY plan_id DESC) AS INTEGER) AS place, CAST(plan_id AS BIGINT) * 10 AS created_at FROM p JOIN n ON n.system_id = s QUALIFY place <= 2"""
)
def plan_store(spark, d):
    """Plans of two destinations, kept with their actions; their latest states, the two newest of each destination."""
    root, actions = shared_dir(spark, "plans"), files(spark, d)
    for plan_id, dest_id, system in ((1, 1, "en"), (2, 2, "de"), (3, 1, "fr"), (4, 1, "en"), (5, 2, "de")):
        own = actions.where(F.col("system_id") == system).select(F.lit("copy").alias("kind"), F.col("id").alias("rom_id"))
        S.save(own, root, plan_id, dest_id, "push_merge", now=F.timestamp_seconds(F.lit(plan_id * 10)))
    for plan_id, status, at in ((1, "partial", 60), (1, "applied", 70), (3, "cancelled", 61), (5, "applied", 62), (5, "partial", 63)):
        S.set_status(spark, root, plan_id, status, now=F.timestamp_seconds(F.lit(at)))
    return S.newest_plans(S.saved_plans(spark, root), 2).drop("mode").withColumn("created_at", F.unix_seconds("created_at"))
