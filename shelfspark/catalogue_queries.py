"""Registered queries of the catalogue operators, each with DuckDB SQL for the same result.

The driver's tables hold no file catalogue, so they are read as one: documents are files (language: system, source: folder,
text: content), labels tell which files are on disk or have metadata, parts give names to parse, orders are
collections and their lines members.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators import catalogue as C
from shelfspark.operators import collections as L
from shelfspark.operators import enrich as E
from shelfspark.operators import lookups as U
from shelfspark.operators import rollups as G
from shelfspark.operators.providers import include_names, listed_names, until_exhausted
from shelfspark.operators.resolve import contained_pick, first_wins, keeper, latest_distinct, preferred_first, reconcile, tier_ladder
from shelfspark.plans import organize as P
from shelfspark.sources import sinks as K
from shelfspark.sources.shared import shared_dir, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Columns of the files, in an SQL that Spark and DuckDB share.
FILES = [
    ("id", "doc_id"),
    ("system_id", "lang"),
    ("folder", "concat('/lib/', lang, '/', source)"),
    ("extension", "CASE n_chars % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.smc' WHEN 2 THEN '.md' ELSE '.zip' END"),
    ("filename", "concat('f', doc_id, CASE n_chars % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.smc' WHEN 2 THEN '.md' ELSE '.zip' END)"),
    ("path", "concat('/lib/', lang, '/', source, '/f', doc_id, CASE n_chars % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.smc' WHEN 2 THEN '.md' ELSE '.zip' END)"),
    ("size_bytes", "n_chars"),
    ("mtime", "CAST(1700000000 + n_chars * 7 AS DOUBLE)"),
    ("sha1", "sha1(text)"),
    ("weak", "left(md5(text), 6)"),
    ("region", "CASE n_chars % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'Europe' WHEN 2 THEN 'Japan' WHEN 3 THEN 'Brazil' END"),
    ("match_confidence", "CASE n_chars % 3 WHEN 0 THEN 'dat_verified' WHEN 1 THEN 'fuzzy' ELSE 'unmatched' END"),
    ("is_hack", "n_chars % 11 = 0"),
    ("missing", "n_chars % 13 = 0"),
    ("fuzzy_key", "left(md5(left(text, 12)), 10)"),
    ("dat_match", "CASE WHEN n_chars % 3 = 0 THEN concat('Title ', left(md5(left(text, 9)), 4)) END"),
]
_A = "a AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FILES) + " FROM documents)"
_PART = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ', The' WHEN 1 THEN ' II' WHEN 2 THEN ' v1.2' ELSE '' END, CASE p_size % 7 WHEN 0 THEN ' (USA)' WHEN 1 THEN ' (USA, Europe)' WHEN 2 THEN ' (Foo)' WHEN 3 THEN ' (Rev 2)' WHEN 4 THEN ' (Switch Online)' WHEN 5 THEN ' (Disc 2 of 3)' ELSE ' (Beta) (En,Fr)' END, CASE p_partkey % 5 WHEN 0 THEN ' [!]' WHEN 1 THEN ' [h1]' WHEN 2 THEN ' [b]' ELSE '' END, '.SFC')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in FILES))


#: The same files in one folder, where every third is to get the name of the next: many renames meet a file.
FLAT = {"folder": "'/lib/x'", "path": f"concat('/lib/x/', {dict(FILES)['filename']})", "dat_match": "CASE WHEN n_chars % 3 = 0 THEN concat('f', doc_id + 1) END", "sha1": "CASE WHEN n_chars % 7 > 1 THEN sha1(left(text, 3)) END"}
_FLAT = "a AS (SELECT " + ", ".join(f"{FLAT.get(n, e)} AS {n}" for n, e in FILES) + " FROM documents)"


def flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{FLAT.get(n, e)} AS {n}" for n, e in FILES))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- duplicates and keepers


@query(f"WITH {_A} SELECT sha1, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM a WHERE sha1 IS NOT NULL GROUP BY sha1 HAVING count(*) > 1")
def dup_groups(spark, d):
    return G.content_groups(files(spark, d))


_RANK = "CASE extension WHEN '.sfc' THEN 0 WHEN '.smc' THEN 1 WHEN '.md' THEN 0 ELSE 2147483647 END"
_DUPES = f"k AS (SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS keeper_id, first_value(path) OVER w AS keeper_path FROM a WHERE NOT is_hack AND sha1 IS NOT NULL WINDOW w AS (PARTITION BY sha1 ORDER BY {_RANK}, length(filename), id)), dup AS (SELECT id AS rom_id, keeper_id AS target_rom_id, path AS source_path, keeper_path AS target_path FROM k WHERE rn > 1)"


@query(f"WITH {_A}, {_DUPES} SELECT 'delete_duplicate' AS kind, rom_id, target_rom_id, source_path, target_path, concat('same content as ', target_path) AS reason FROM dup")
def dup_keeper_plan(spark, d):
    return P.duplicates(files(spark, d))


_HASHED = "CASE WHEN n_chars % 17 = 0 THEN NULL WHEN n_chars % 19 = 0 THEN '' WHEN doc_id % 2 = 0 THEN upper(sha1(text)) ELSE sha1(text) END"


@query(f"WITH {_A.replace('sha1(text) AS sha1', _HASHED + ' AS sha1')}, k AS (SELECT id, sha1, row_number() OVER (PARTITION BY lower(sha1) ORDER BY CASE WHEN match_confidence = 'dat_verified' THEN 0 ELSE 1 END, {_RANK}, length(filename), id) AS rn FROM a) SELECT id, sha1 FROM k WHERE rn = 1 OR coalesce(sha1, '') = ''")
def distinct_keepers(spark, d):
    items = table(spark, d, "documents").selectExpr(*(f"{_HASHED if n == 'sha1' else e} AS {n}" for n, e in FILES))
    return P.distinct_keepers(items).select("id", "sha1")


@query("SELECT source, lang, CAST(min(doc_id) AS BIGINT) AS doc_id, CAST(arg_min(n_chars, (-n_chars, doc_id)) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang")
def preferred_row(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", F.struct(-F.col("n_chars"), "doc_id")).alias("n_chars"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 0 AND l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 1 ELSE CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END AS BIGINT) AS is_preferred FROM lineitem")
def ensure_one_preferred(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("is_preferred"))
    return preferred_first(rows, ["l_orderkey"], "is_preferred", "l_linenumber").withColumn("is_preferred", F.col("is_preferred").cast("long"))


# ---- filters, anti and semi joins


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unhashed_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {_A} SELECT a.id FROM a JOIN labels l ON a.id = l.doc_id AND 1700000000 + l.quality * 7000 < a.mtime")
def stale_hash_theta(spark, d):
    a, hashed = files(spark, d), table(spark, d, "labels").select("doc_id", (F.col("quality") * 7000 + 1700000000).alias("hashed_at"))
    return a.join(hashed, (a.id == hashed.doc_id) & (hashed.hashed_at < a.mtime)).select("id")


@query(f"WITH {_A} SELECT id FROM a WHERE (match_confidence = 'dat_verified' OR fuzzy_key <> '') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id)")
def enrich_candidates(spark, d):
    a = files(spark, d).where("match_confidence = 'dat_verified' OR fuzzy_key <> ''")
    return a.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id")


@query(f"WITH {_A}, m AS (SELECT DISTINCT doc_id FROM labels), h AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT a.id, a.system_id, CASE a.system_id WHEN 'en' THEN 'EN' WHEN 'de' THEN 'German' ELSE a.system_id END AS system_name, coalesce(a.region, '') AS region, m.doc_id IS NOT NULL AS has_metadata, h.doc_id IS NOT NULL AS has_cover FROM a LEFT JOIN m ON m.doc_id = a.id LEFT JOIN h ON h.doc_id = a.id")
def enrich_status_grid(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "rom_id")
    systems = spark.createDataFrame([("en", "EN", "English"), ("de", None, "German")], "id string, short_name string, display_name string")
    grid = U.enrichment_grid(files(spark, d), systems, labels, labels.where("toxic = 1"))
    return grid.select("id", "system_id", "system_name", "region", "has_metadata", F.col("has_covers").alias("has_cover"))


@query(f"WITH {_A} SELECT id FROM a WHERE contains(lower(filename), '1') AND (region IS NOT NULL AND region <> '' AND region NOT IN ('USA', 'Europe', 'Japan', 'World')) AND match_confidence IN ('dat_verified', 'header')")
def grid_filters(spark, d):
    return U.grid(files(spark, d), text="1", region="Other", confidence="Verified").select("id")


@query(f"WITH {_A} SELECT id, path FROM a WHERE system_id IN ('en', 'de') AND (region IN ('USA') OR region IS NULL) AND id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def export_candidates(spark, d):
    picked = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("rom_id"))
    return U.export_candidates(files(spark, d), systems=["en", "de"], regions=["USA", "Other"], members=picked).select("id", "path")


@query(f"WITH {_A} SELECT id, filename, size_bytes FROM a ORDER BY filename, id LIMIT 50")
def page_limit(spark, d):
    return files(spark, d).orderBy("filename", "id").select("id", "filename", "size_bytes").limit(50)


# ---- counts


@query(f"WITH {_A} SELECT system_id, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY system_id")
def system_counts(spark, d):
    return files(spark, d).groupBy("system_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_members FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def collection_counts(spark, d):
    members = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders")
    return o.join(members, o.o_orderkey == members.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_members"))


@query(f"WITH {_A} SELECT system_id, lower(regexp_replace(path, '/[^/]*$', '')) AS folder, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2")
def folder_counts(spark, d):
    return G.folder_counts(files(spark, d))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS large, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def scan_counters(spark, d):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("found"), count(F.col("event_type") == "error").alias("errors"), count(F.col("value") > 50).alias("large"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 5")
def mru_top5(spark, d):
    return latest_distinct(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 5)


@query("SELECT p_type AS extension, min(p_brand) AS system_id FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) = 1")
def unique_ext_map(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("extension")).agg(F.min("p_brand").alias("system_id"), F.max("p_brand").alias("last")).where("system_id = last").drop("last")


# ---- ladders

_REG = "r AS (SELECT doc_id AS entry_id, sha1(text) AS sha1, left(md5(text), 6) AS weak, n_chars AS size_bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), s AS (SELECT sha1, min(entry_id) AS e FROM r GROUP BY sha1), w AS (SELECT weak, size_bytes, min(entry_id) AS e FROM r GROUP BY 1, 2 HAVING count(*) = 1)"


def _registry(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    return docs.selectExpr("doc_id AS entry_id", "sha1(text) AS sha1", "left(md5(text), 6) AS weak", "n_chars AS size_bytes")


@query(f"WITH {_A}, {_REG} SELECT a.id, coalesce(s.e, w.e) AS entry_id, CAST(CASE WHEN s.e IS NOT NULL THEN 1 WHEN w.e IS NOT NULL THEN 2 END AS INTEGER) AS match_tier FROM a LEFT JOIN s ON s.sha1 = a.sha1 LEFT JOIN w ON w.weak = a.weak AND w.size_bytes = a.size_bytes")
def dat_match_two_tier(spark, d):
    return C.registry_match(files(spark, d), _registry(spark, d)).select("id", "entry_id", "match_tier")


@query(f"WITH {_REG} SELECT weak, size_bytes, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def dat_ambiguity_gate(spark, d):
    return _registry(spark, d).groupBy("weak", "size_bytes").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {_A}, donor AS (SELECT a.* FROM a JOIN labels l ON l.doc_id = a.id), t AS (SELECT * FROM a WHERE id NOT IN (SELECT doc_id FROM labels)), x AS (SELECT sha1, min(id) AS i FROM donor GROUP BY 1), y AS (SELECT system_id, dat_match, min(id) AS i FROM donor WHERE dat_match IS NOT NULL GROUP BY 1, 2), z AS (SELECT system_id, fuzzy_key, min(id) AS i FROM donor GROUP BY 1, 2) SELECT t.id, coalesce(x.i, y.i, z.i) AS donor_id, CAST(CASE WHEN x.i IS NOT NULL THEN 1 WHEN y.i IS NOT NULL THEN 2 WHEN z.i IS NOT NULL THEN 3 END AS INTEGER) AS match_tier FROM t LEFT JOIN x ON x.sha1 = t.sha1 LEFT JOIN y ON y.system_id = t.system_id AND y.dat_match = t.dat_match LEFT JOIN z ON z.system_id = t.system_id AND z.fuzzy_key = t.fuzzy_key")
def sibling_metadata_ladder(spark, d):
    a, have = files(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    out = C.sibling_donor(a.join(have, "id", "left_anti"), a.join(have, "id", "left_semi"), [["sha1"], ["system_id", "dat_match"], ["system_id", "fuzzy_key"]])
    return out.select("id", "donor_id", "match_tier")


@query(f"WITH {_A}, cover AS (SELECT a.id, a.sha1, a.system_id, a.dat_match, a.fuzzy_key FROM a JOIN labels l ON l.doc_id = a.id WHERE l.toxic = 1), hit AS (SELECT t.id, c.id AS cover_id, 1 AS tier FROM a t JOIN cover c ON c.sha1 = t.sha1 AND c.id <> t.id UNION ALL SELECT t.id, c.id, 2 FROM a t JOIN cover c ON c.system_id = t.system_id AND c.dat_match = t.dat_match AND c.id <> t.id UNION ALL SELECT t.id, c.id, 3 FROM a t JOIN cover c ON c.system_id = t.system_id AND c.fuzzy_key = t.fuzzy_key AND c.id <> t.id), best AS (SELECT id, min(tier) AS tier FROM hit GROUP BY id) SELECT hit.id, hit.cover_id, hit.tier FROM hit JOIN best ON best.id = hit.id AND best.tier = hit.tier")
def sibling_covers_rank(spark, d):
    return E.sibling_covers(*_siblings(spark, d))


def _siblings(spark, d):
    keys = [["sha1"], ["system_id", "dat_match"], ["system_id", "fuzzy_key"]]
    a = files(spark, d).select("id", "sha1", "system_id", "dat_match", "fuzzy_key")
    own = a.join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return a, own.withColumnRenamed("id", "rom_id").withColumn("cover_id", F.col("rom_id")), keys


@query(f"WITH {_A}, cover AS (SELECT a.id, a.sha1, a.system_id, a.dat_match, a.fuzzy_key FROM a JOIN labels l ON l.doc_id = a.id WHERE l.toxic = 1), hit AS (SELECT t.id, 1 AS tier, count(*) AS n FROM a t JOIN cover c ON c.sha1 = t.sha1 AND c.id <> t.id GROUP BY 1 UNION ALL SELECT t.id, 2, count(*) FROM a t JOIN cover c ON c.system_id = t.system_id AND c.dat_match = t.dat_match AND c.id <> t.id GROUP BY 1 UNION ALL SELECT t.id, 3, count(*) FROM a t JOIN cover c ON c.system_id = t.system_id AND c.fuzzy_key = t.fuzzy_key AND c.id <> t.id GROUP BY 1) SELECT id, CAST(min(tier) AS INTEGER) AS tier, arg_min(n, tier) AS n_covers FROM hit GROUP BY id")
def sibling_cover_classes(spark, d):
    """How many covers of others each item may take, from classes and members: no pair is made."""
    members, classes = E.sibling_cover_classes(*_siblings(spark, d))
    size = classes.groupBy("class").agg(F.count("*").alias("n"))
    own = classes.groupBy("class", F.col("rom_id").alias("id")).agg(F.count("*").alias("mine"))
    return members.join(size, "class").join(own, ["class", "id"], "left").select("id", "tier", (F.col("n") - F.coalesce("mine", F.lit(0))).alias("n_covers"))


@query("WITH t AS (SELECT p_partkey, p_name, p_brand, p_type FROM part), x AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part WHERE p_size > 25 GROUP BY 1, 2), y AS (SELECT p_name, max(p_partkey) AS k FROM part WHERE p_retailprice > 1000 GROUP BY 1), z AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1) SELECT t.p_partkey, coalesce(x.k, y.k, z.k) AS found, CASE WHEN x.k IS NOT NULL THEN 'title' WHEN y.k IS NOT NULL THEN 'index' WHEN z.k IS NOT NULL THEN 'lookup' END AS source FROM t LEFT JOIN x ON x.p_name = t.p_name AND x.p_brand = t.p_brand LEFT JOIN y ON y.p_name = t.p_name LEFT JOIN z ON z.p_type = t.p_type")
def provider_ladder(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    one = first_wins(part.where("p_size > 25").select("p_name", "p_brand", k.alias("found")), ["p_name", "p_brand"], [F.col("found")])
    two = first_wins(part.where("p_retailprice > 1000").select("p_name", k.alias("found")), ["p_name"], [-F.col("found")])
    three = first_wins(part.select("p_type", k.alias("found")), ["p_type"], [F.col("found")])
    out = tier_ladder(part, [(one, ["p_name", "p_brand"]), (two, ["p_name"]), (three, ["p_type"])], ["found"])
    return out.select("p_partkey", "found", F.element_at(F.array(*map(F.lit, ["title", "index", "lookup"])), F.col("match_tier")).alias("source"))


@query("WITH p AS (SELECT p_partkey, p_brand, lower(p_name) AS k FROM part), j AS (SELECT a.p_partkey, b.p_partkey AS other FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.k = b.k OR (length(a.k) >= 12 AND length(b.k) >= 12 AND (contains(a.k, b.k) OR contains(b.k, a.k)))) SELECT p_partkey, min(other) AS pick FROM j GROUP BY p_partkey")
def substring_pick(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.lower("p_name").alias("k"))
    return contained_pick(p, "p_brand", "k", "p_partkey").where("pick IS NOT NULL")


# ---- names

_TAGS = f"n AS (SELECT p_partkey, {_PART} AS name FROM part), s AS (SELECT p_partkey, name, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem FROM n), t AS (SELECT *, regexp_extract_all(stem, '\\(([^()]*)\\)', 1) AS tags, regexp_extract_all(stem, '\\[([^\\[\\]]*)\\]', 1) AS marks, trim(regexp_replace(regexp_replace(stem, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM s)"


def _names(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_PART} AS name")


@query(f"WITH {_TAGS} SELECT p_partkey, clean AS clean_name, concat(CASE WHEN ends_with(clean, ', The') THEN concat('The ', left(clean, length(clean) - 5)) ELSE clean END, CASE WHEN list_contains(tags, 'Switch Online') THEN ' (Switch Online)' ELSE '' END) AS display_title, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS extension, list_filter(tags, lambda x: regexp_matches(x, '^(?i)rev\\s+\\S+$'))[1] AS revision, list_contains(marks, '!') AS is_verified, len(list_filter(marks, lambda x: regexp_matches(x, '^b[0-9]*$'))) > 0 AS is_bad_dump, len(list_filter(marks, lambda x: regexp_matches(x, '^h[0-9]*$'))) > 0 AS is_hack, list_contains(tags, 'Beta') AS is_beta, CASE WHEN list_contains(tags, 'Switch Online') THEN 'Switch Online' END AS release_type, CAST(CASE WHEN list_contains(tags, 'Disc 2 of 3') THEN 2 END AS INTEGER) AS disc_number FROM t")
def parse_tags(spark, d):
    f = N.parsed(F.col("name"))
    return _names(spark, d).select("p_partkey", *(f[c].alias(c) for c in ("clean_name", "display_title", "extension", "revision", "is_verified", "is_bad_dump", "is_hack", "is_beta", "release_type", "disc_number")))


@query(f"WITH {_TAGS} SELECT p_partkey, list_filter(tags, lambda x: x IN ('USA', 'USA, Europe', 'En,Fr'))[1] AS region FROM t")
def region_all_tokens(spark, d):
    return _names(spark, d).select("p_partkey", N.parsed(F.col("name"))["region"].alias("region"))


_FOLD = "CASE WHEN ends_with(clean, ', The') THEN concat('The ', left(clean, length(clean) - 5)) ELSE clean END"


@query(f"WITH {_TAGS} SELECT p_partkey, {_FOLD} AS title FROM t")
def article_fold(spark, d):
    return _names(spark, d).select("p_partkey", N.article_first(N.clean_name(N.stem(F.col("name")))).alias("title"))


@query(f"WITH {_TAGS} SELECT p_partkey, concat(regexp_replace(lower(regexp_replace(regexp_replace(CASE WHEN ends_with(clean, ', The') THEN left(clean, length(clean) - 5) ELSE clean END, ' II$', ' 2'), ' v1\\.2$', '')), '[^a-z0-9]', '', 'g'), CASE WHEN list_contains(tags, 'Switch Online') THEN '__switchonline' ELSE '' END) AS fuzzy_key FROM t")
def fuzzy_key(spark, d):
    return _names(spark, d).select("p_partkey", N.parsed(F.col("name"))["fuzzy_key"].alias("fuzzy_key"))


@query("SELECT page_id, regexp_replace(trim(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g')), '[. ]+$', '') AS safe FROM pages")
def sanitize_name(spark, d):
    return table(spark, d, "pages").select("page_id", N.safe_filename(F.col("url")).alias("safe"))


_PATHS = "concat(CASE p_size % 10 WHEN 0 THEN 'roms/' WHEN 1 THEN '/etc/' WHEN 2 THEN '../' WHEN 3 THEN 'nes\\\\' WHEN 4 THEN 'c:' WHEN 5 THEN 'con/' WHEN 6 THEN 'a/LPT1.txt/' WHEN 7 THEN 'a//b/aux. /' WHEN 8 THEN 'content/' ELSE 'a/b..c/' END, p_name)"


@query("SELECT p_partkey, p_size % 10 IN (0, 8, 9) AS is_safe FROM part")
def safe_paths(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_PATHS} AS path").select("p_partkey", N.valid_relative_path(F.col("path")).alias("is_safe"))


@query("SELECT p_partkey, concat('https://t/', replace(p_brand, '#', '%23'), '/Named_Snaps/', replace(concat(p_name, '_ ', 'x_y'), ' ', '%20'), '.png') AS url, concat('/cache/', p_brand, '/Named_Snaps/', p_name, '_ x_y.png') AS cache_path FROM part")
def thumbnail_urls(spark, d):
    name, kind = F.concat("p_name", F.lit(": x/y")), F.lit("Named_Snaps")
    return table(spark, d, "part").select("p_partkey", N.thumbnail_url("https://t/", F.col("p_brand"), name, kind).alias("url"), N.cover_cache_path("/cache", F.col("p_brand"), name, kind).alias("cache_path"))


@query("SELECT p_partkey, right(concat('00000000', lower(to_hex(p_partkey * 7919))), 8) AS crc FROM part")
def crc_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", N.crc_key(F.concat(F.lit("0x"), F.hex(F.col("p_partkey") * 7919)), clamp=True).alias("crc"))


@query("SELECT o_orderkey, CAST(CASE WHEN y BETWEEN 1970 AND 2100 THEN y END AS INTEGER) AS release_year FROM (SELECT o_orderkey, TRY_CAST(left(CAST(o_orderdate AS VARCHAR), 4) AS INTEGER) AS y FROM orders)")
def year_extract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.release_year(F.col("o_orderdate").cast("string")).alias("release_year"))


@query("SELECT doc_id, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat((n * 20 + 1024) // 2048 // 10, '.', ((n * 20 + 1024) // 2048) % 10, ' KB') WHEN n < 1073741824 THEN concat((n * 20 + 1048576) // 2097152 // 10, '.', ((n * 20 + 1048576) // 2097152) % 10, ' MB') END AS size_text FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)")
def size_format(spark, d):
    return table(spark, d, "documents").select("doc_id", N.size_text(F.col("n_chars") * 37).alias("size_text"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, split_part(url, '/', -1) AS base, len(string_split(url, '/')) > 4 AS deep FROM pages")
def path_ops(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", N.parent(u).alias("parent"), N.base_name(u).alias("base"), (F.size(F.split(u, "/")) > 4).alias("deep"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Named_Boxarts' WHEN 1 THEN 'Named_Snaps' WHEN 2 THEN 'Named_Titles' ELSE 'Named_Boxarts' END AS kind FROM part")
def cover_type_infer(spark, d):
    path = "concat('/x/', CASE p_size % 4 WHEN 0 THEN 'media/BoxArt' WHEN 1 THEN 'snaps/eu' WHEN 2 THEN 'x/titles' ELSE 'other/y' END, '/', p_partkey, '.png')"
    return table(spark, d, "part").selectExpr("p_partkey", f"{path} AS path").select("p_partkey", N.cover_kind(F.col("path")).alias("kind"))


@query(f"WITH {_A} SELECT id, CAST(CASE match_confidence WHEN 'dat_verified' THEN 3 WHEN 'header' THEN 2 WHEN 'fuzzy' THEN 1 ELSE 0 END AS INTEGER) AS confidence, concat(left(sha1, 8), '…', right(sha1, 4)) AS short, extension IN ('.zip', '.7z') AS is_archive, length(sha1) IN (8, 32, 40) AS valid FROM a")
def scalar_rules(spark, d):
    return files(spark, d).select("id", N.confidence_rank(F.col("match_confidence")).alias("confidence"), N.short_hash(F.col("sha1")).alias("short"), F.col("extension").isin(N.ARCHIVES).alias("is_archive"), N.valid_hash(F.col("sha1")).alias("valid"))


# ---- snapshots


@query("WITH o AS (SELECT doc_id, lang AS title, CASE n_chars % 3 WHEN 0 THEN 'dat_verified' WHEN 1 THEN 'fuzzy' ELSE 'unmatched' END AS match_confidence, n_chars AS size_bytes, TRUE AS missing FROM documents), n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'new' END AS title, CASE quality WHEN 1 THEN 'header' ELSE 'fuzzy' END AS match_confidence, CAST(quality AS BIGINT) AS size_bytes FROM labels) SELECT coalesce(n.doc_id, o.doc_id) AS path, coalesce(n.title, o.title) AS title, CASE WHEN n.doc_id IS NOT NULL AND (o.doc_id IS NULL OR CASE n.match_confidence WHEN 'header' THEN 2 ELSE 1 END >= CASE o.match_confidence WHEN 'dat_verified' THEN 3 WHEN 'fuzzy' THEN 1 ELSE 0 END) THEN n.match_confidence ELSE o.match_confidence END AS match_confidence, CASE WHEN n.doc_id IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes, n.doc_id IS NULL AS missing FROM o FULL JOIN n ON n.doc_id = o.doc_id")
def upsert_merge(spark, d):
    old = table(spark, d, "documents").selectExpr("doc_id AS path", "lang AS title", "CASE n_chars % 3 WHEN 0 THEN 'dat_verified' WHEN 1 THEN 'fuzzy' ELSE 'unmatched' END AS match_confidence", "n_chars AS size_bytes", "TRUE AS missing")
    new = table(spark, d, "labels").selectExpr("doc_id AS path", "CASE WHEN toxic = 1 THEN 'new' END AS title", "CASE quality WHEN 1 THEN 'header' ELSE 'fuzzy' END AS match_confidence", "CAST(quality AS LONG) AS size_bytes", "FALSE AS missing")
    return C.upsert(old, new)


@query(f"WITH {_A} SELECT path FROM a WHERE id NOT IN (SELECT doc_id FROM labels)")
def missing_sweep(spark, d):
    a = files(spark, d)
    visited = a.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return C.sweep_missing(a, visited).select("path")


@query("SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rom_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rom_id"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return C.cascade(gone, {"lines": lines})["lines"].withColumnRenamed("rom_id", "l_orderkey")


_DISK = "disk AS (SELECT a.path, a.size_bytes + 1 - l.quality AS disk_size, a.mtime + 3 * l.toxic AS disk_mtime FROM a JOIN labels l ON l.doc_id = a.id)"


def _disk(spark, d):
    a = files(spark, d)
    j = a.join(table(spark, d, "labels"), F.col("doc_id") == F.col("id"))
    return j.select("path", (F.col("size_bytes") + 1 - F.col("quality")).alias("disk_size"), (F.col("mtime") + 3 * F.col("toxic")).alias("disk_mtime"), F.lit(True).alias("readable"))


@query(f"WITH {_A}, {_DISK}, c AS (SELECT *, CASE WHEN region = 'Japan' THEN '/old/' WHEN region = 'USA' THEN '/lib/' END AS library_root FROM a) SELECT id, status FROM (SELECT c.id, CASE WHEN library_root = '/old/' THEN 'outside_root' WHEN disk_size IS NULL AND NOT missing THEN 'missing_unflagged' WHEN disk_size IS NOT NULL AND missing THEN 'flagged_but_present' WHEN disk_size IS NOT NULL AND (size_bytes <> disk_size OR abs(mtime - disk_mtime) >= 2) THEN 'drift' END AS status FROM c LEFT JOIN disk ON disk.path = c.path) WHERE status IS NOT NULL")
def scrub_classify(spark, d):
    root = F.when(F.col("region") == "Japan", "/old/").when(F.col("region") == "USA", "/lib/")
    return C.scrub(files(spark, d).withColumn("library_root", root), _disk(spark, d), "/lib").select("id", "status")


@query(f"WITH {_A}, {_DISK} SELECT d.path AS rel_path, d.disk_size AS size_bytes, CASE WHEN d.disk_size = a.size_bytes AND d.disk_mtime = a.mtime THEN a.sha1 END AS sha1, coalesce(d.disk_size = a.size_bytes AND d.disk_mtime = a.mtime, FALSE) AS reused FROM disk d LEFT JOIN a ON a.path = d.path")
def inventory_refresh(spark, d):
    cached = files(spark, d).select(F.col("path").alias("rel_path"), "size_bytes", "mtime", "sha1", F.col("id").alias("rom_id"))
    present = _disk(spark, d).select(F.col("path").alias("rel_path"), F.col("disk_size").alias("size_bytes"), F.col("disk_mtime").alias("mtime"))
    return C.inventory_refresh(cached, present).select("rel_path", "size_bytes", "sha1", "reused")


@query(f"WITH {_A}, p AS (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) AS rn FROM (SELECT DISTINCT folder, path FROM a)) SELECT folder, sha1(string_agg(path, chr(0) ORDER BY path)) AS signature FROM p WHERE rn <= 32 GROUP BY folder")
def ordered_signature(spark, d):
    return C.signature(files(spark, d), "folder", "path")


# ---- sync

_SIDE = "(split_part(lower(rel_path), '/', -1) = 'gamelist.xml' OR ends_with(split_part(lower(rel_path), '/', -1), '.m3u') OR list_has_any(string_split(lower(rel_path), '/'), ['downloaded_media', 'imgs', 'media']))"
_L = "l AS (SELECT id AS rom_id, concat('roms/', system_id, '/', filename) AS rel_path, size_bytes, mtime, sha1, fuzzy_key, coalesce(lower(region), '') AS region, system_id FROM a)"
_E = "e AS (SELECT CASE WHEN b.toxic = 1 THEN concat('roms/', a.system_id, '/moved/', a.filename) WHEN a.is_hack THEN concat('roms/media/', a.filename) ELSE concat('roms/', a.system_id, '/', a.filename) END AS rel_path, a.size_bytes + 1 - b.quality AS size_bytes, a.mtime + CASE WHEN a.missing THEN -5 ELSE 5 END AS mtime, CASE WHEN a.extension <> '.zip' THEN sha1(concat(a.sha1, CASE WHEN b.quality = 1 THEN '' ELSE 'x' END)) ELSE CASE WHEN b.toxic = 1 THEN a.sha1 END END AS sha1, CASE WHEN a.extension = '.md' THEN concat(a.fuzzy_key, 'q') ELSE a.fuzzy_key END AS fuzzy_key, coalesce(lower(a.region), '') AS region, a.system_id FROM a JOIN labels b ON b.doc_id = a.id)"
_ID = f"{_A}, {_L}, {_E}, fk AS (SELECT fuzzy_key, region, system_id, arg_min(rel_path, rel_path) AS k_path, arg_min(size_bytes, rel_path) AS k_size, arg_min(coalesce(sha1, ''), rel_path) AS k_sha, arg_min(mtime, rel_path) AS k_mtime FROM e WHERE fuzzy_key <> '' GROUP BY 1, 2, 3), f AS (SELECT l.rel_path, l.rom_id, l.size_bytes, l.sha1, l.mtime, coalesce(p.rel_path, k_path) AS dest_path, CASE WHEN p.rel_path IS NOT NULL THEN p.size_bytes ELSE k_size END AS dest_size, CASE WHEN p.rel_path IS NOT NULL THEN coalesce(p.sha1, '') ELSE k_sha END AS dest_sha, CASE WHEN p.rel_path IS NOT NULL THEN p.mtime ELSE k_mtime END AS dest_mtime FROM l LEFT JOIN e p ON p.rel_path = l.rel_path LEFT JOIN fk ON fk.fuzzy_key = l.fuzzy_key AND fk.region = l.region AND fk.system_id = l.system_id), x AS (SELECT sha1, min(rom_id) AS i FROM l GROUP BY 1), y AS (SELECT rel_path, max(rom_id) AS i FROM l GROUP BY 1), z AS (SELECT fuzzy_key, region, system_id, min(rom_id) AS i FROM l GROUP BY 1, 2, 3), b AS (SELECT e.rel_path, e.size_bytes, coalesce(x.i, y.i, z.i) AS rom_id FROM e LEFT JOIN x ON x.sha1 = e.sha1 LEFT JOIN y ON y.rel_path = e.rel_path LEFT JOIN z ON z.fuzzy_key = e.fuzzy_key AND z.region = e.region AND z.system_id = e.system_id WHERE NOT {_SIDE.replace('rel_path', 'e.rel_path')})"
_AHEAD = "SELECT CASE WHEN dest_path IS NULL THEN 'copy_to_dest' ELSE 'identical' END AS kind, coalesce(dest_path, rel_path) AS rel_path, rom_id, coalesce(dest_size, size_bytes) AS size_bytes FROM f"
_DIFF = "(dest_path IS NOT NULL AND CASE WHEN dest_sha <> '' THEN sha1 <> dest_sha ELSE size_bytes <> dest_size END)"


def _sides(spark, d):
    a = files(spark, d)
    region = F.coalesce(F.lower("region"), F.lit("")).alias("region")
    local = U.local_files(a)
    b = a.join(table(spark, d, "labels"), F.col("doc_id") == F.col("id"))
    path = F.expr("CASE WHEN toxic = 1 THEN concat('roms/', system_id, '/moved/', filename) WHEN is_hack THEN concat('roms/media/', filename) ELSE concat('roms/', system_id, '/', filename) END")
    sha = F.expr("CASE WHEN extension <> '.zip' THEN sha1(concat(sha1, CASE WHEN quality = 1 THEN '' ELSE 'x' END)) ELSE CASE WHEN toxic = 1 THEN sha1 END END")
    dest = b.select(F.lit(None).cast("long").alias("rom_id"), path.alias("rel_path"), (F.col("size_bytes") + 1 - F.col("quality")).alias("size_bytes"), (F.col("mtime") + F.when(F.col("missing"), -5).otherwise(5)).alias("mtime"), sha.alias("sha1"), F.expr("CASE WHEN extension = '.md' THEN concat(fuzzy_key, 'q') ELSE fuzzy_key END").alias("fuzzy_key"), region, "system_id")
    return local, dest


@query(f"WITH {_ID} {_AHEAD}")
def sync_push_merge(spark, d):
    return C.sync_plan(*_sides(spark, d), "push_merge").drop("resolution")


@query(f"WITH {_ID} {_AHEAD} UNION ALL SELECT 'delete_dest', rel_path, NULL, size_bytes FROM b WHERE rom_id IS NULL AND starts_with(rel_path, 'roms/')")
def sync_push_mirror(spark, d):
    return C.sync_plan(*_sides(spark, d), "push_mirror", base_path="roms").drop("resolution")


@query(f"WITH {_A}, {_L}, {_E} SELECT 'copy_to_dest' AS kind, rel_path, rom_id, size_bytes FROM l UNION ALL SELECT 'delete_dest', rel_path, NULL, size_bytes FROM e WHERE NOT {_SIDE}")
def sync_push_wipe(spark, d):
    return C.sync_plan(*_sides(spark, d), "push_wipe", base_path="roms").drop("resolution")


@query(f"WITH {_ID} SELECT CASE WHEN rom_id IS NULL THEN 'copy_to_local' ELSE 'identical' END AS kind, rel_path, rom_id, size_bytes FROM b")
def sync_pull(spark, d):
    return C.sync_plan(*_sides(spark, d), "pull").drop("resolution")


@query(f"WITH {_ID} SELECT CASE WHEN dest_path IS NULL THEN 'copy_to_dest' WHEN {_DIFF} THEN 'conflict' ELSE 'identical' END AS kind, coalesce(dest_path, rel_path) AS rel_path, rom_id, CASE WHEN dest_path IS NULL THEN size_bytes WHEN {_DIFF} THEN greatest(size_bytes, dest_size) ELSE dest_size END AS size_bytes FROM f UNION ALL SELECT 'copy_to_local', rel_path, NULL, size_bytes FROM b WHERE rom_id IS NULL")
def sync_two_way(spark, d):
    return C.sync_plan(*_sides(spark, d), "two_way", policy="newest").drop("resolution")


@query(f"WITH {_ID} SELECT rom_id, CASE WHEN mtime > dest_mtime THEN 'local' WHEN dest_mtime > mtime THEN 'dest' ELSE 'skip' END AS resolution FROM f WHERE {_DIFF}")
def conflict_policy(spark, d):
    return C.sync_plan(*_sides(spark, d), "two_way", policy="newest").where("kind = 'conflict'").select("rom_id", "resolution")


@query(f"WITH {_A}, {_DISK}, st AS (SELECT id, path AS target_path, size_bytes, sha1, CASE WHEN is_hack THEN NULL ELSE system_id END AS system_id, extension = '.zip' AND id % 9 = 0 AS is_multi FROM a), c AS (SELECT a.id, a.path, a.sha1 FROM a JOIN labels l ON l.doc_id = a.id WHERE l.toxic = 1), h AS (SELECT sha1, min(id) AS i FROM c GROUP BY 1), r AS (SELECT st.id, c.id AS c_id, h.i, CASE WHEN is_multi THEN 'multi_rom_archive' WHEN c.id IS NOT NULL THEN 'dupe_path' WHEN disk.disk_size = st.size_bytes THEN 'dupe_path' WHEN disk.disk_size <> st.size_bytes THEN 'dupe_filename' WHEN h.i IS NOT NULL AND st.system_id IS NOT NULL THEN 'dupe_hash' ELSE 'new' END AS status FROM st LEFT JOIN c ON c.path = st.target_path LEFT JOIN disk ON disk.path = st.target_path LEFT JOIN h ON h.sha1 = st.sha1) SELECT id, status, CASE status WHEN 'new' THEN 'copy' ELSE 'skip' END AS resolution, CASE status WHEN 'dupe_path' THEN c_id WHEN 'dupe_hash' THEN i END AS collides_with FROM r")
def import_classify(spark, d):
    a, labels = files(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    multi = ((F.col("extension") == ".zip") & (F.col("id") % 9 == 0)).alias("is_multi")
    staged = a.select("id", F.col("path").alias("target_path"), "size_bytes", "sha1", F.when(~F.col("is_hack"), F.col("system_id")).alias("system_id"), multi)
    known = a.join(labels.where("toxic = 1"), "id").select("id", "path", "sha1")
    return C.import_status(staged, known, _disk(spark, d).select("path", F.col("disk_size").alias("size_bytes"))).select("id", "status", "resolution", "collides_with")


# ---- plans

_REN = f"del AS (SELECT rom_id FROM dup), ren0 AS (SELECT id AS rom_id, path AS source_path, concat(folder, '/', dat_match, extension) AS target_path FROM a WHERE match_confidence = 'dat_verified' AND dat_match <> '' AND id NOT IN (SELECT rom_id FROM del)), ren AS (SELECT * FROM ren0 WHERE source_path <> target_path)"


@query(f"WITH {_A}, {_DUPES}, {_REN} SELECT rom_id, source_path, target_path FROM ren")
def rename_plan(spark, d):
    a = files(spark, d)
    return P.renames(a, P.duplicates(a)).select("rom_id", "source_path", "target_path")


_COLL = f"{_REN}, g AS (SELECT target_path, count(*) AS rivals, arg_min(rom_id, rom_id) AS rom_id, arg_min(source_path, rom_id) AS source_path FROM ren GROUP BY 1), j AS (SELECT g.*, EXISTS (SELECT 1 FROM ren r WHERE r.source_path = g.target_path) AS moved, t.id AS t_id, t.sha1 AS t_sha, t.is_hack AS t_hack, s.sha1 AS s_sha, s.is_hack AS s_hack FROM g LEFT JOIN a t ON t.path = g.target_path AND t.id NOT IN (SELECT rom_id FROM ren) LEFT JOIN a s ON s.id = g.rom_id), c AS (SELECT *, CASE WHEN rivals > 1 OR moved THEN 'collision' WHEN t_id IS NULL THEN 'rename' WHEN coalesce(t_sha = s_sha, FALSE) AND NOT t_hack AND NOT s_hack THEN 'delete_duplicate' ELSE 'collision' END AS kind FROM j)"


@query(f"WITH {_A}, {_DUPES}, {_COLL} SELECT kind, rom_id, source_path, target_path FROM c")
def collision_plan(spark, d):
    a = files(spark, d)
    return P.collisions(P.renames(a, P.duplicates(a)), a).select("kind", "rom_id", "source_path", "target_path")


@query(f"WITH {_FLAT}, {_DUPES}, {_COLL} SELECT target_path AS collision, 0 AS ordinal, 'delete_file' AS kind, t_id AS rom_id, target_path AS source_path, NULL AS target_path FROM c WHERE kind = 'collision' AND rivals = 1 AND NOT moved UNION ALL SELECT target_path, 1, 'rename', rom_id, source_path, target_path FROM c WHERE kind = 'collision' AND rivals = 1 AND NOT moved")
def resolve_collision_explode(spark, d):
    a = flat_files(spark, d)
    return P.resolutions(P.collisions(P.renames(a, P.duplicates(a)), a), "replace_target").drop("reason")


@query(f"WITH {_FLAT}, {_DUPES}, {_COLL} SELECT target_path AS collision, 0 AS ordinal, 'delete_file' AS kind, rom_id, source_path FROM c WHERE kind = 'collision'")
def resolve_collision_source(spark, d):
    a = flat_files(spark, d)
    return P.resolutions(P.collisions(P.renames(a, P.duplicates(a)), a), "delete_source").drop("reason", "target_path")


@query(f"WITH {_FLAT}, {_DUPES}, {_COLL}, o AS (SELECT target_path, unnest(CASE WHEN rivals = 1 AND NOT moved AND t_id IS NOT NULL THEN ['do_nothing', 'delete_source', 'replace_target'] ELSE ['do_nothing', 'delete_source'] END) AS choice FROM c WHERE kind = 'collision') SELECT target_path AS collision, list_position(['do_nothing', 'delete_source', 'replace_target'], choice) - 1 AS ordinal, choice FROM o")
def resolution_choices(spark, d):
    a = flat_files(spark, d)
    return P.available_resolutions(P.collisions(P.renames(a, P.duplicates(a)), a))


@query(f"WITH {_FLAT}, {_DUPES}, {_COLL} SELECT kind, rom_id, source_path, target_path FROM c")
def collision_plan_flat(spark, d):
    a = flat_files(spark, d)
    return P.collisions(P.renames(a, P.duplicates(a)), a).select("kind", "rom_id", "source_path", "target_path")


_MERGES = "ff AS (SELECT system_id, folder, split_part(folder, '/', -1) AS alias FROM a GROUP BY 1, 2), ft AS (SELECT system_id, min(folder) AS target FROM ff WHERE alias IN ('src0', 'src1') GROUP BY 1), mg AS (SELECT ff.folder, ft.target FROM ff JOIN ft ON ft.system_id = ff.system_id WHERE ff.alias NOT IN ('src0', 'src1'))"


def _aliases(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("system_id"), F.lower("source").alias("alias")).distinct().withColumn("canonical", F.col("alias").isin("src0", "src1"))


@query(f"WITH {_A}, {_DUPES}, {_COLL}, {_MERGES} SELECT 'merge_folder' AS kind, NULL AS rom_id, NULL AS target_rom_id, folder AS source_path, target AS target_path FROM mg UNION ALL SELECT 'delete_duplicate', rom_id, target_rom_id, source_path, target_path FROM dup UNION ALL SELECT 'rename', rom_id, NULL, source_path, target_path FROM ren WHERE target_path NOT IN (SELECT target_path FROM c WHERE kind <> 'rename') UNION ALL SELECT kind, rom_id, CASE WHEN rivals = 1 AND NOT moved THEN t_id END, source_path, target_path FROM c WHERE kind <> 'rename'")
def analyze_library(spark, d):
    return P.analyze(files(spark, d), _aliases(spark, d)).drop("reason")


@query(f"WITH {_A}, {_DUPES}, {_COLL} SELECT kind, CAST(count(*) AS BIGINT) AS n_actions FROM (SELECT kind FROM c UNION ALL SELECT 'delete_duplicate' FROM dup) GROUP BY kind")
def plan_counts(spark, d):
    a = files(spark, d)
    dupes = P.duplicates(a)
    return P.counts(P.collisions(P.renames(a, dupes), a).unionByName(dupes))


@query(f"WITH {_ID} SELECT count(*) FILTER (WHERE rom_id IS NULL) > 0 AS is_destructive FROM b")
def plan_destructive(spark, d):
    plan = C.sync_plan(*_sides(spark, d), "push_mirror", base_path="roms")
    return plan.agg(F.coalesce(F.bool_or(F.col("kind") == "delete_dest"), F.lit(False)).alias("is_destructive"))


@query(f"WITH {_A}, f AS (SELECT system_id, folder, split_part(folder, '/', -1) AS alias, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT system_id, min(folder) AS target FROM f WHERE alias IN ('src0', 'src1') GROUP BY 1) SELECT f.system_id, f.folder, t.target, CAST(f.n AS BIGINT) AS n_files FROM f JOIN t ON t.system_id = f.system_id WHERE f.alias NOT IN ('src0', 'src1')")
def alias_merge_plan(spark, d):
    return P.alias_merges(files(spark, d), _aliases(spark, d))


_TAKEN = "concat(p_name, CASE p_size % 4 WHEN 0 THEN '_imported' WHEN 1 THEN '_imported_2' WHEN 2 THEN '_imported_5' ELSE '' END, '.SFC')"


@query(f"WITH w AS (SELECT p_partkey AS id, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part), t AS (SELECT DISTINCT p_name, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS n FROM part WHERE p_size > 30 AND p_size % 4 < 3), l AS (SELECT p_name, list(n) AS ns FROM t GROUP BY 1), f AS (SELECT id, w.p_name, list_filter(range(1, k + 4), lambda x: NOT list_contains(coalesce(ns, []), x))[k] AS n FROM w LEFT JOIN l ON l.p_name = w.p_name) SELECT id, concat(p_name, '.SFC') AS name, concat(p_name, CASE WHEN n = 1 THEN '_imported' ELSE concat('_imported_', n) END, '.SFC') AS free_name FROM f")
def unique_names(spark, d):
    part = table(spark, d, "part")
    return P.unique_names(part.selectExpr("p_partkey AS id", "concat(p_name, '.SFC') AS name"), part.where("p_size > 30").selectExpr(f"{_TAKEN} AS name"))


# ---- export


@query(f"WITH {_A} SELECT system_id, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, CAST(count(*) FILTER (WHERE extension = '.zip') AS BIGINT) AS n_archives, CAST(count(DISTINCT folder) AS BIGINT) AS n_folders FROM a GROUP BY system_id")
def export_preview(spark, d):
    by = files(spark, d).groupBy("system_id", "folder").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"), F.sum((F.col("extension") == ".zip").cast("long")).alias("z"))
    return by.groupBy("system_id").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.sum("z").alias("n_archives"), F.count("*").alias("n_folders"))


@query(f"WITH {_A} SELECT system_id, CAST(grouping(system_id) AS INTEGER) AS is_total, CAST(count(*) AS BIGINT) AS copied, CAST(count(*) FILTER (WHERE missing) AS BIGINT) AS skipped FROM a GROUP BY ROLLUP (system_id)")
def export_per_system_rollup(spark, d):
    return C.totals(files(spark, d), "system_id", {"copied": F.count("*"), "skipped": F.sum(F.col("missing").cast("long"))})


@query("WITH f AS (SELECT p_brand, concat(p_name, ' (Disc ', p_size, ').cue') AS filename, p_name FROM part) SELECT p_brand, p_name AS base, CAST(count(*) AS INTEGER) AS n_discs, string_agg(filename, chr(10) ORDER BY filename) AS content FROM f GROUP BY 1, 2 HAVING count(*) >= 2")
def m3u_groups(spark, d):
    f = table(spark, d, "part").select("p_brand", F.concat("p_name", F.lit(" (Disc "), "p_size", F.lit(").cue")).alias("filename"))
    return C.playlists(f, ["p_brand"])


@query("WITH f AS (SELECT p_brand, concat(p_name, ' (Disc ', p_size, ').cue') AS filename, p_name FROM part) SELECT concat(p_brand, '/', p_name, '.m3u') AS rel_path, concat(string_agg(filename, chr(10) ORDER BY filename), chr(10)) AS content FROM f GROUP BY p_brand, p_name HAVING count(*) >= 2")
def playlist_files(spark, d):
    """Playlists as files in their folders, read back."""
    root = shared_dir(spark, "playlists").removeprefix("file://").removeprefix("file:")
    written = K.write_texts(K.playlist_files(m3u_groups(spark, d), "p_brand"), root)
    done = written.where("n_bytes IS NOT NULL").agg(F.count("*")).first()[0]
    lists = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True) if done else spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    path = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    return lists.select(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1).alias("rel_path"), F.col("value").alias("content"))


# ---- JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page, coalesce(nullif(json_extract_string(props, '$.title'), ''), nullif(json_extract_string(props, '$.page'), ''), event_type) AS title FROM events")
def json_synonyms(spark, d):
    get = lambda p: F.get_json_object("props", p)
    return table(spark, d, "events").select("event_id", get("$.page").alias("page"), F.coalesce(F.nullif(get("$.title"), F.lit("")), F.nullif(get("$.page"), F.lit("")), "event_type").alias("title"))


@query("WITH i AS (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 1, 99]) AS k, unnest([1, 2, 3]) AS o FROM customer) SELECT c_custkey, string_agg(coalesce(n_name, CAST(k AS VARCHAR)), ', ' ORDER BY o) AS names FROM i LEFT JOIN nation ON n_nationkey = k GROUP BY c_custkey")
def id_list_resolve(spark, d):
    """Lists of ids in answers, read with the names that the answer itself includes."""
    ids = F.array(*((F.col("c_nationkey") + F.lit(k)).cast("string") for k in (0, 1)), F.lit("99"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.struct(F.col("n_name").alias("name")).alias("n"))
    one = names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "n")))).alias("block"))  # the 25 nations: one row
    answers = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey")).crossJoin(F.broadcast(one))
    answer = F.concat(F.lit('{"data": {"game": '), F.to_json(F.struct(ids.alias("genres"))), F.lit('}, "include": {"genres": '), "block", F.lit("}}"))
    found = listed_names(F.get_json_object("answer", "$.data.game"), ["genres"], include_names(F.col("answer"), "genres"))
    return answers.withColumn("answer", answer).select("c_custkey", found.alias("names"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def quota_cut(spark, d):
    """Calls of each run as long as its allowance of three lasts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = table(spark, d, "events").withColumn("n", F.row_number().over(w)).withColumn("remaining", 3 - F.col("n"))
    return until_exhausted(calls, "user_id", "n").select("user_id", "event_id")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM documents LEFT JOIN labels l USING (doc_id)")
def reconcile_sides(spark, d):
    return reconcile(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "side")


# ---- collections and destinations


@query("WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'), m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') SELECT o.o_orderkey AS id, o.o_orderstatus = 'F' AS is_system, CAST(count(l_partkey) AS BIGINT) AS n_members FROM orders o LEFT JOIN m ON l_orderkey = o_orderkey WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY 1, 2")
def collection_edits(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderstatus") == "F").alias("is_system"), "o_orderpriority")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("rom_id"), "l_returnflag")
    members = L.add_members(lines.where("l_returnflag = 'N'").dropDuplicates(["collection_id", "rom_id"]), lines.where("l_returnflag = 'A'"))
    kept, members, _ = L.delete(orders.drop("o_orderpriority"), members, orders.where("o_orderpriority = '1-URGENT'"))
    return L.sizes(kept, members).select("id", "is_system", "n_members")


@query("WITH s AS (SELECT p_name, min(p_partkey) AS i FROM part WHERE p_size > 30 GROUP BY 1), n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY concat('/mnt/', p_partkey)) AS k FROM part WHERE p_partkey NOT IN (SELECT i FROM s)) SELECT concat('/mnt/', s.i) AS target_path, s.p_name AS name, FALSE AS is_new FROM s UNION ALL SELECT concat('/mnt/', p_partkey), CASE WHEN s.i IS NULL AND k = 1 THEN n.p_name ELSE concat(n.p_name, ' (', k + CASE WHEN s.i IS NULL THEN 0 ELSE 1 END, ')') END, TRUE FROM n LEFT JOIN s ON s.p_name = n.p_name")
def destination_names(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("/mnt/"), "p_partkey").alias("target_path"), F.col("p_brand").alias("profile_id"), "p_size")
    saved = first_wins(part.where("p_size > 30").drop("p_size"), ["name"], [F.col("id")])
    return L.ensure_destinations(saved, part).select("target_path", "name", "is_new")
