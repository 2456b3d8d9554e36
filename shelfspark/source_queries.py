"""Registered queries of sources, sinks, byte rules, covers, export and the streamed catalogue.

The tables hold no files, so each query has Spark write the files (or bytes) that its rows stand for to the shared folder
and reads those back.  The SQL gives the same rows from the tables.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.catalogue_queries import _A, _RANK, files, table
from shelfspark.functions import content as B
from shelfspark.functions import names as N
from shelfspark.operators import enrich as E
from shelfspark.plans import organize as P
from shelfspark.plans import saved as S
from shelfspark.sources import profiles as Y
from shelfspark.sources import registries as R
from shelfspark.sources import sinks as K
from shelfspark.sources import tree as T
from shelfspark.sources.shared import shared_dir, spread
from shelfspark.streaming.catalogue import run_available

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- registries and lookup files

_GAME = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' (USA)' WHEN 1 THEN ' (Rev 2)' WHEN 2 THEN ' (Foo) (Europe, Japan)' ELSE ' (Homebrew) [h2]' END, ' & <', p_partkey, '>')"
_TOKENS = f"regexp_replace({_GAME}, ' *(\\([^()]*\\)|\\[[^\\]]*\\])', '', 'g') AS title, p_size % 4 = 3 AS is_hack, p_size % 4 = 3 AS is_homebrew"


@query(f"SELECT p_partkey AS size_bytes, {_GAME} AS game_name, concat(p_name, '.bin') AS rom_name, right(concat('00000000', lower(to_hex(p_partkey))), 8) AS crc32, sha1(p_name) AS sha1, CASE p_size % 4 WHEN 0 THEN 'USA' WHEN 2 THEN 'Europe, Japan' END AS region, CASE p_size % 4 WHEN 1 THEN 'Rev 2' END AS revision, p_size % 7 = 0 AS is_bios, {_TOKENS} FROM part UNION ALL SELECT p_partkey, {_GAME}, 'second.bin', NULL, NULL, CASE p_size % 4 WHEN 0 THEN 'USA' WHEN 2 THEN 'Europe, Japan' END, CASE p_size % 4 WHEN 1 THEN 'Rev 2' END, p_size % 7 = 0, {_TOKENS} FROM part WHERE p_size % 3 = 0")
def registry_xml(spark, d):
    rom = "struct({name} AS _name, p_partkey AS _size, {crc} AS _crc, {sha} AS _sha1)"
    first = rom.format(name="concat(p_name, '.bin')", crc="upper(lpad(hex(p_partkey), 8, '0'))", sha="upper(sha1(p_name))")
    second = rom.format(name="'second.bin'", crc="CAST(NULL AS STRING)", sha="CAST(NULL AS STRING)")
    path = shared_dir(spark, "registry")
    games = table(spark, d, "part").selectExpr(f"{_GAME} AS _name", "CASE WHEN p_size % 7 = 0 THEN 'yes' END AS _isbios", f"CASE WHEN p_size % 3 = 0 THEN array({first}, {second}) ELSE array({first}) END AS rom")
    games.write.format("xml").option("rootTag", "datafile").option("rowTag", "game").save(path)
    return R.registry_entries(spark, path).drop("dat_file", "md5")


@query("SELECT p_partkey AS size_bytes, concat(p_name, ' (USA)') AS game_name, sha1(p_name) AS sha1, CASE b % 3 WHEN 0 THEN 'sys0' WHEN 1 THEN 'sys1' END AS system_id FROM (SELECT *, p_partkey // 100 AS b FROM part) WHERE b % 5 <> 4")
def registry_load(spark, d):
    game = "concat('<game name=\"', p_name, ' (USA)\"><rom name=\"', p_name, '.bin\" size=\"', p_partkey, '\" sha1=\"', sha1(p_name), '\"/></game>') AS game"
    books = table(spark, d, "part").selectExpr("p_partkey div 100 AS b", game).groupBy("b").agg(F.array_join(F.collect_list("game"), "").alias("games"))  # a hundred entries a file
    texts = books.selectExpr("concat('dats/', b % 2, '/sub/book', b, CASE WHEN b % 5 = 4 THEN '.txt' WHEN b % 2 = 0 THEN '.dat' ELSE '.xml' END) AS rel_path", "concat('<datafile><header><name>DAT ', b % 3, '</name></header>', games, '</datafile>') AS content")
    root = shared_dir(spark, "registries").removeprefix("file://").removeprefix("file:")
    K.write_texts(texts, root).write.format("noop").mode("overwrite").save()
    systems = spark.range(2).selectExpr("concat('sys', id) AS id", "concat('dat ', id) AS dat_name", "CAST(NULL AS ARRAY<STRING>) AS dat_name_aliases")
    return R.load_registries(spark, [f"{root}/dats", f"{root}/dats/0"], systems).select("size_bytes", "game_name", "sha1", "system_id")


@query("SELECT lower(right(concat('00000000', to_hex(p_partkey)), 8)) AS crc, p_type AS genre, CASE WHEN p_size > 10 THEN p_brand END AS publisher FROM part")
def dimension_text(spark, d):
    part = table(spark, d, "part").withColumn("crc", F.hex("p_partkey"))
    read = {}
    for name, column, rows in (("genre", "p_type", part), ("publisher", "p_brand", part.where("p_size > 10"))):
        path = shared_dir(spark, name)
        block = 'game (\n\tcomment "%s (USA)"\n\t' + name + ' "%s"\n\trom ( crc %s )\n)\n'
        rows.select(F.format_string(block, "p_name", column, "crc")).write.text(path)
        read[name] = R.dimension_values(spark, path, name)
    return R.dimension_index(read)


_DIMENSION_COLUMNS = {"developer": "p_name", "esrb": "p_brand", "franchise": "p_type", "genre": "p_type", "maxusers": "string(p_size)", "publisher": "p_brand", "releaseyear": "string(1960 + p_size)"}


@query("SELECT p_partkey, p_brand AS system_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS developer, CASE WHEN p_size % 3 = 0 THEN p_brand END AS esrb, CASE WHEN p_size % 4 = 0 THEN p_type END AS franchise, CASE WHEN p_size % 5 = 0 THEN p_type END AS genre, CASE WHEN p_size % 6 = 0 THEN CAST(p_size AS VARCHAR) END AS maxusers, CASE WHEN p_size % 7 = 0 THEN p_brand END AS publisher, CASE WHEN p_size % 8 = 0 THEN CAST(1960 + p_size AS VARCHAR) END AS releaseyear FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0")
def dimension_join(spark, d):
    part = table(spark, d, "part").withColumn("crc", F.hex("p_partkey"))
    root = shared_dir(spark, "dimensions").removeprefix("file://").removeprefix("file:")
    texts = None
    for k, (name, value) in enumerate(_DIMENSION_COLUMNS.items(), start=2):
        block = 'game (\n\tcomment "%s"\n\t' + name + ' "%s"\n\trom ( crc %s )\n)\n'
        own = part.where(F.col("p_size") % k == 0).select(F.concat(F.expr("p_partkey div 1000"), F.lit(f"/{name}/"), F.regexp_replace("p_brand", "#", " "), F.lit(".dat")).alias("rel_path"), F.format_string(block, "p_name", F.expr(value), "crc").alias("block"))
        texts = own if texts is None else texts.unionByName(own)
    texts = texts.groupBy("rel_path").agg(F.array_join(F.collect_list("block"), "").alias("content"))  # at most a thousand entries a file
    K.write_texts(texts, root).write.format("noop").mode("overwrite").save()
    systems = part.select(F.col("p_brand").alias("id"), F.regexp_replace("p_brand", "#", " ").alias("dimension_name")).distinct()
    items = part.select("p_partkey", F.col("p_brand").alias("system_id"), N.crc_key(F.col("crc"), clamp=True).alias("crc"))
    return R.dimension_match(items, R.dimension_table(spark, root, systems)).drop("crc")


@query("WITH e AS (SELECT * FROM part WHERE p_size > 10), t AS (SELECT DISTINCT p_name FROM e) SELECT p.p_partkey, CASE WHEN p.p_size > 10 AND p.p_size % 2 = 0 THEN p.p_name ELSE t.p_name END AS title, CAST(CASE WHEN p.p_size > 10 AND p.p_size % 2 = 0 THEN 1 WHEN t.p_name IS NOT NULL THEN 3 END AS INTEGER) AS match_tier FROM part p LEFT JOIN t ON t.p_name = p.p_name")
def json_lookup(spark, d):
    part = table(spark, d, "part")
    entry = F.struct(F.concat(F.lit("0x"), F.hex("p_partkey")).alias("crc32"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"))
    books = part.where("p_size > 10").groupBy(F.floor(F.col("p_partkey") / 500).alias("book"))
    path = shared_dir(spark, "lookup")
    books.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), entry)))).alias("value")).write.partitionBy("book").text(path)
    items = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, N.crc_key(F.hex("p_partkey"), clamp=False)).alias("crc"), F.lit(None).cast("string").alias("canonical_key"), N.title_key(F.col("p_name")).alias("title_key"))
    return R.json_match(items, R.json_entries(spark, path), ["title"]).select("p_partkey", "title", "match_tier")


@query("WITH g AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_brand END AS system_id, p_name, min(p_type) AS genre FROM part WHERE p_size > 20 GROUP BY 1, 2) SELECT p.p_partkey, coalesce(a.genre, b.genre) AS genre, CAST(CASE WHEN a.genre IS NOT NULL THEN 1 WHEN b.genre IS NOT NULL THEN 2 END AS INTEGER) AS match_tier FROM part p LEFT JOIN g a ON a.system_id = p.p_brand AND a.p_name = p.p_name LEFT JOIN g b ON b.system_id IS NULL AND b.p_name = p.p_name")
def title_xml(spark, d):
    part = table(spark, d, "part")
    titles = part.where("p_size > 20").groupBy(F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand END").alias("Platform"), F.col("p_name").alias("Name")).agg(F.min("p_type").alias("Genres"))
    path = shared_dir(spark, "titles")
    titles.fillna("Unmapped", ["Platform"]).write.format("xml").option("rootTag", "LaunchBox").option("rowTag", "Game").save(path)
    platforms = part.select(F.col("p_brand").alias("platform"), F.col("p_brand").alias("system_id")).distinct()
    items = part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("system_id"))
    return R.title_match(items, R.title_entries(spark, path, platforms), ["genre"]).select("p_partkey", "genre", "match_tier")


@query("SELECT concat('sys', p_partkey) AS id, p_name AS display_name, concat('.x', p_size) AS extension, CAST(p_size AS INTEGER) AS generation, CASE WHEN p_size % 9 = 0 THEN 'extension' WHEN p_size % 7 = 0 THEN 'header_rule' END AS problem FROM part")
def yaml_registry(spark, d):
    entry = "concat('  - id: sys', p_partkey, '\\n    display_name: \"', p_name, '\"\\n    short_name: S\\n    generation: ', p_size, '\\n    extensions: [', if(p_size % 9 = 0, 'nodot, ', ''), '.X', p_size, ']\\n', if(p_size % 7 = 0, '    header_rule: other\\n', '')) AS entry"
    root = shared_dir(spark, "systems").removeprefix("file://").removeprefix("file:")
    K.write_books(table(spark, d, "part").selectExpr("floor(p_partkey / 100) AS book", entry), root, "systems:\n")  # a hundred entries a file
    return Y.registry_systems(spark, root).select("id", "display_name", F.element_at("extensions", -1).alias("extension"), "generation", "problem")


# ---- trees and sinks


@query("SELECT concat('Sys', page_id % 5, CASE page_id % 3 WHEN 0 THEN '/_unsorted' WHEN 1 THEN '/sub/deep' ELSE '' END, '/p', page_id, '.html') AS rel_path, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size_bytes, CASE WHEN page_id % 5 < 4 THEN concat('system', CASE WHEN page_id % 3 = 0 THEN 9 ELSE page_id % 5 END) WHEN page_id % 3 = 0 THEN 'system9' END AS system_id FROM pages")
def tree_scan(spark, d):
    root = shared_dir(spark, "tree").removeprefix("file://").removeprefix("file:")
    rel = "concat('Sys', page_id % 5, CASE page_id % 3 WHEN 0 THEN '/_unsorted' WHEN 1 THEN '/sub/deep' ELSE '' END, '/p', page_id, '.html') AS rel_path"
    K.write_texts(table(spark, d, "pages").selectExpr(rel, "coalesce(html, '') AS content"), root).write.format("noop").mode("overwrite").save()
    spark.dataSource.register(T.TreeSource)
    listed = spark.read.format("tree").option("path", root).load()
    systems = spark.range(4).selectExpr("concat('system', id) AS id", "id AS ord", "array(concat('SYS', id)) AS folder_aliases")
    systems = systems.unionByName(spark.range(1).selectExpr("'system9' AS id", "9L AS ord", "array('_unsorted') AS folder_aliases"))
    return T.resolve_systems(listed, T.alias_table(systems)).select("rel_path", "size_bytes", "system_id")


@query(f"WITH {_A} SELECT a.system_id, concat('./', a.filename) AS path, coalesce(a.dat_match, concat('f', a.id)) AS name, CASE WHEN l.toxic = 1 THEN concat('./media/f', a.id, '.png') END AS image, CASE WHEN l.quality = 1 THEN concat('<', a.folder, ' & co>') END AS descr, a.region AS genre FROM a LEFT JOIN labels l ON l.doc_id = a.id".replace("a.region AS genre", "CASE WHEN l.doc_id IS NOT NULL THEN a.region END AS genre"))
def gamelist_xml(spark, d):
    a, labels = files(spark, d), table(spark, d, "labels")
    items = a.select("id", "system_id", "filename", F.lit("").alias("title"), F.col("dat_match").alias("canonical_name"))
    j = a.join(labels, F.col("doc_id") == F.col("id"))
    empty = [F.lit("").alias(c) for c in ("release_date", "developer", "publisher", "players", "rating")]
    metadata = j.select(F.col("id").alias("rom_id"), F.when(F.col("quality") == 1, F.concat(F.lit("<"), "folder", F.lit(" & co>"))).alias("description"), F.col("region").alias("genre"), *empty)
    covers = j.where("toxic = 1").select("id", F.col("id").alias("rom_id"), F.concat(F.lit("/c/"), "id", F.lit(".png")).alias("local_path"), F.lit(True).alias("is_preferred"))
    path = shared_dir(spark, "gamelists")
    K.write_gamelists(K.gamelist_rows(items, metadata, covers), path)
    return K.read_gamelists(spark, path).select("system_id", "path", "name", "image", F.col("desc").alias("descr"), "genre")


# ---- bytes

_BODY = "repeat(md5(text), 32)"


@query("SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN sha1(repeat(md5(text), 32)) ELSE sha1(text) END AS sha1, md5(CASE n_chars % 4 WHEN 0 THEN repeat(md5(text), 32) ELSE text END) AS md5, CAST(CASE n_chars % 4 WHEN 0 THEN 1024 ELSE strlen(text) END AS BIGINT) AS size FROM documents")
def header_digests(spark, d):
    rule = "CASE n_chars % 4 WHEN 0 THEN 'smc_512' WHEN 1 THEN 'ines_16' WHEN 2 THEN 'lynx_64' END AS rule"
    body = f"CASE n_chars % 4 WHEN 0 THEN concat(encode(repeat('x', 512), 'utf-8'), encode({_BODY}, 'utf-8')) WHEN 1 THEN concat(X'4E45531A', encode(repeat('0', 12), 'utf-8'), encode(text, 'utf-8')) WHEN 2 THEN concat(X'4C594E5800', encode(repeat('0', 59), 'utf-8'), encode(text, 'utf-8')) ELSE encode(text, 'utf-8') END AS content"
    rows = table(spark, d, "documents").selectExpr("doc_id", rule, body).withColumn("bare", B.normalized(F.col("content"), F.col("rule")))
    out = B.digests(F.col("bare"))
    return rows.select("doc_id", out["sha1"].alias("sha1"), out["md5"].alias("md5"), out["size"].alias("size"))


@query("SELECT doc_id, sha1(concat('7@', repeat(md5(text), 32))) AS sha1 FROM documents")
def byte_order_digests(spark, d):
    # the big-endian form begins with its magic; the two ASCII characters make what follows whole units
    big = F.expr(f"concat(X'80371240', encode('7@', 'utf-8'), encode({_BODY}, 'utf-8'), X'0000')")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", big.alias("big"))
    pairs = F.unhex(F.regexp_replace(F.hex("big"), "(..)(..)", "$2$1"))
    words = F.unhex(F.regexp_replace(F.hex("big"), "(..)(..)(..)(..)", "$4$3$2$1"))
    stored = F.when(F.col("n_chars") % 3 == 0, pairs).when(F.col("n_chars") % 3 == 1, words).otherwise(F.col("big"))
    bare = B.normalized(stored, F.lit("n64_byteswap"))
    return rows.select("doc_id", bare.alias("b")).select("doc_id", F.sha1(F.expr("substring(b, 5, octet_length(b) - 6)")).alias("sha1"))


@query("SELECT doc_id, sha1(text) AS sha1, n_chars % 2 = 0 AS is_multi FROM documents")
def archive_digests(spark, d):
    @F.pandas_udf("binary")
    def pack(text: pd.Series, two: pd.Series) -> pd.Series:
        def one(t, more):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("game.sfc", t)
                if more:
                    z.writestr("readme.smc", b"")
            return out.getvalue()

        return pd.Series([one(t, m) for t, m in zip(text, two, strict=True)])

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pack("text", F.col("n_chars") % 2 == 0).alias("z"))
    return docs.select("doc_id", F.sha1(B.payload(F.col("z"), F.lit(".ZIP"))).alias("sha1"), B.is_multi_archive(F.col("z"), [".sfc", ".smc"]).alias("is_multi"))


@query("SELECT doc_id, concat('GAME ', left(md5(text), 6)) AS title FROM documents")
def inner_titles(spark, d):
    title = "rpad(concat('GAME  ', left(md5(text), 6)), {n}, ' ')"
    cut = lambda lead, n: f"encode(concat(repeat('x', {lead}), {title.format(n=n)}, repeat('x', 64)), 'utf-8')"
    mega = f"encode(concat(repeat('x', 256), rpad('SEGA GENESIS', 32, 'y'), {title.format(n=48)}), 'utf-8')"
    snes = lambda at: f"encode(concat(repeat('h', 512), repeat(char(1), {at}), {title.format(n=21)}, repeat(char(1), {0x10000 - at - 21})), 'utf-8')"
    n64 = f"concat(X'80371240', encode(concat(repeat('x', 28), {title.format(n=20)}, repeat('x', 64)), 'utf-8'))"
    systems = "CASE n_chars % 7 WHEN 0 THEN 'gb' WHEN 1 THEN 'gba' WHEN 2 THEN 'megadrive' WHEN 3 THEN 'snes' WHEN 4 THEN 'snes' WHEN 5 THEN 'n64' ELSE 'nds' END AS system"
    pairs = f"unhex(regexp_replace(hex({n64}), '(..)(..)', '$2$1'))"
    content = f"CASE n_chars % 7 WHEN 0 THEN {cut(0x134, 16)} WHEN 1 THEN {cut(0xA0, 12)} WHEN 2 THEN {mega} WHEN 3 THEN {snes(0x7FC0)} WHEN 4 THEN {snes(0xFFC0)} WHEN 5 THEN {pairs} ELSE {cut(0, 12)} END AS content"
    rows = table(spark, d, "documents").selectExpr("doc_id", systems, content)
    return rows.select("doc_id", B.inner_title(F.col("content"), F.col("system")).alias("title"))


# ---- covers and export


@query("WITH i AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 25) SELECT p.p_partkey AS id, concat('/lib/', p.p_brand, '/snaps/', p.p_name, ' (Europe).PNG') AS image_path, 'Named_Snaps' AS cover_type FROM part p JOIN i ON i.p_brand = p.p_brand AND i.p_name = p.p_name")
def local_covers(spark, d):
    part = table(spark, d, "part")
    path = F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), "p_name", F.lit(" (USA) (Switch Online).sfc"))
    items = spread(part).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("system_id"), path.alias("path"), N.parsed(N.base_name(path))["fuzzy_key"].alias("fuzzy_key"), F.col("p_name").alias("clean_name"))
    images = part.where("p_size > 25").select(F.col("p_brand").alias("system_id"), F.concat(F.lit("/lib/"), "p_brand", F.lit("/snaps/"), "p_name", F.lit(" (Europe).PNG")).alias("image_path")).distinct()
    return E.local_covers(items, images).select("id", "image_path", "cover_type")


@query("SELECT doc_id AS id, t AS cover_type FROM documents d, (VALUES ('Named_Boxarts'), ('Named_Snaps'), ('Named_Titles')) v(t) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND t = CASE l.quality WHEN 1 THEN 'Named_Boxarts' ELSE 'Named_Snaps' END)")
def cover_fetch_plan(spark, d):
    covers = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "Named_Boxarts").otherwise("Named_Snaps").alias("cover_type"))
    return E.cover_fetches(table(spark, d, "documents").select(F.col("doc_id").alias("id")), covers)


@query(f"WITH {_A} SELECT a.id, CASE WHEN a.system_id <> 'fr' THEN concat('roms/', upper(a.system_id), '/', a.filename) END AS dest_path, CASE WHEN a.system_id = 'fr' THEN 'unsupported' WHEN a.missing THEN 'source_missing' WHEN l.quality = 1 THEN 'already_present' WHEN l.quality = 0 THEN 'refused' ELSE 'copy' END AS status FROM a LEFT JOIN labels l ON l.doc_id = a.id")
def export_classify(spark, d):
    a = files(spark, d)
    mappings = a.select("system_id").distinct().withColumn("folder", F.upper("system_id")).withColumn("supported", F.col("system_id") != "fr")
    j = a.join(table(spark, d, "labels"), F.col("doc_id") == F.col("id"))
    dest = j.select(F.concat(F.lit("roms/"), F.upper("system_id"), F.lit("/"), "filename").alias("rel_path"), (F.col("size_bytes") + 1 - F.col("quality")).alias("size_bytes"))
    return E.export_status(a, mappings, a.where("NOT missing"), dest, base_path="roms/").select("id", "dest_path", "status")


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.page'), ''), 'none') AS title FROM events")
def localized_json(spark, d):
    page = F.get_json_object("props", "$.page")
    text = F.struct(F.lit("en").alias("langue"), page.alias("text"))
    other = F.struct(F.lit("de").alias("langue"), F.lit("anders").alias("text"))
    shape = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.array(other, text).alias("nom")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(text.alias("nom")))).otherwise(F.to_json(F.struct(page.alias("nom"))))
    rows = table(spark, d, "events").select("event_id", page.alias("page"), shape.alias("j"))
    got = E.localized(F.col("j"), "$.nom", ["en", "us"])
    return rows.select("event_id", F.coalesce(F.when(F.col("page").isNotNull(), got), F.lit("none")).alias("title"))


@query(f"WITH {_A}, s AS (SELECT sha1, min(id) AS i FROM a WHERE id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT a.id, CASE WHEN l.doc_id IS NOT NULL THEN a.id ELSE s.i END AS value FROM a LEFT JOIN labels l ON l.doc_id = a.id LEFT JOIN s ON s.sha1 = a.sha1 WHERE l.doc_id IS NOT NULL OR s.i IS NOT NULL")
def sibling_spread(spark, d):
    a = files(spark, d).select("id", "sha1")
    values = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("value"))
    return E.spread_to_siblings(values, a, [["sha1"]])


@query(f"WITH {_A} SELECT a.id, coalesce(a.dat_match, a.filename) AS display_title, a.dat_match AS registry_name, CASE l.quality WHEN 1 THEN '1990-01-02' WHEN 0 THEN '1991' END AS released, CASE WHEN NOT a.is_hack THEN concat(left(a.sha1, 8), '…', right(a.sha1, 4)) END AS sha1_short, coalesce(l.toxic = 1, FALSE) AS is_favourite FROM a LEFT JOIN labels l ON l.doc_id = a.id")
def detail_view(spark, d):
    a, labels = files(spark, d), table(spark, d, "labels")
    items = a.select("id", "filename", F.lit("").alias("title"), F.col("dat_match").alias("canonical_name"), "dat_match", "match_confidence", "size_bytes")
    metadata = labels.select(F.col("doc_id").alias("rom_id"), F.when(F.col("quality") == 1, "1990-01-02").otherwise("").alias("release_date"), F.lit(1991).alias("release_year"))
    hashes = a.where("NOT is_hack").select(F.col("id").alias("rom_id"), "sha1")
    return E.details(items, metadata, hashes, labels.where("toxic = 1").select(F.col("doc_id").alias("rom_id"))).drop("size_text")


@query(f"WITH {_A} SELECT id, CASE WHEN system_id IN ('en', 'de') THEN system_id END AS system_id, concat(CASE WHEN system_id IN ('en', 'de') THEN system_id ELSE '_unsorted' END, '/', filename) AS landing_path FROM a")
def pull_landing(spark, d):
    a = files(spark, d)
    mappings = a.select("system_id").distinct().where("system_id IN ('en', 'de')").withColumn("folder", F.upper("system_id"))
    there = a.select("id", F.concat(F.lit("ROMs/"), F.when(F.col("is_hack"), F.upper("system_id")).otherwise(F.col("system_id")), F.lit("/sub/"), "filename").alias("rel_path"))
    return E.destination_systems(there, mappings, "roms").drop("rel_path")


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS p, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) OVER w AS any_chosen, min(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) OVER w AS best FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN any_chosen = 1 THEN l_linenumber = best ELSE p END AS is_preferred FROM c")
def preferred_covers(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("rom_id"), F.lit("Named_Boxarts").alias("cover_type"), (F.col("l_returnflag") == "R").alias("is_preferred"), "l_linestatus")
    return E.set_preferred(rows.drop("l_linestatus"), rows.where("l_linestatus = 'F'")).select("id", "is_preferred")


@query(f"WITH {_A}, k AS (SELECT id, path, row_number() OVER w AS rn, first_value(id) OVER w AS keeper_id, first_value(path) OVER w AS keeper_path FROM a WHERE NOT is_hack WINDOW w AS (PARTITION BY sha1 ORDER BY {_RANK}, length(filename), id)) SELECT 'delete_duplicate' AS kind, id AS rom_id, keeper_id AS target_rom_id, path AS source_path, keeper_path AS target_path, concat('same content as ', keeper_path) AS reason FROM k WHERE rn > 1 AND id NOT IN (SELECT doc_id FROM labels)")
def saved_plan(spark, d):
    a = files(spark, d)
    plan, root = P.duplicates(a), shared_dir(spark, "plans")
    S.save(plan, root, 1, 1, "organize")
    unlabelled = a.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select(F.col("id").alias("rom_id"))
    return S.approved(S.load(spark, root, 1, plan.schema), unlabelled, ["rom_id"])


@query("SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes, CAST(max(n_chars) AS BIGINT) AS largest FROM documents")
def staging_size(spark, d):
    return E.file_totals(files(spark, d))


# ---- the streamed catalogue


@query("SELECT concat('/x/', doc_id // 3) AS path, arg_max(source, doc_id) AS title, CASE WHEN min(doc_id % 3) = 0 THEN 'header' ELSE 'fuzzy' END AS match_confidence, arg_max(n_chars, doc_id) AS size_bytes, FALSE AS missing FROM documents GROUP BY 1")
def stream_catalogue(spark, d):
    """Three files that come one after another, a batch each: the later ones have paths of the earlier ones again, with less certain matches."""
    docs, arriving = table(spark, d, "documents"), shared_dir(spark, "arriving")
    rows = docs.selectExpr("concat('/x/', doc_id div 3) AS path", "source AS title", "if(doc_id % 3 = 0, 'header', 'fuzzy') AS match_confidence", "n_chars AS size_bytes", "FALSE AS missing", "doc_id AS mtime")
    for k in range(3):
        rows.where(F.col("mtime") % 3 == k).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    return run_available(stream, shared_dir(spark, "catalogue"), order="mtime")
