"""Registered queries of providers' answers and payloads, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.catalogue_queries import table
from shelfspark.operators import providers as P
from shelfspark.sources.shared import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Answers as a provider would give them, one for each part: plain or within a wrapper, with null and empty fields. The same text in both dialects.
_BODY = """concat('{"name":"', p_name, '","summary":"","overview":"', p_type, '","esrb":', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE concat('"', p_brand, '"') END, ',"genres":["a","b"],"publishers":"', p_brand, '","released":"', 1960 + p_size, '-01-02"}')"""
_ANSWER = f"""CASE p_size % 4 WHEN 0 THEN {_BODY} WHEN 1 THEN concat('{{"game":', {_BODY}, '}}') WHEN 2 THEN concat('{{"game":"none","data":', {_BODY}, '}}') ELSE concat('{{"result":', {_BODY}, ',"title":"other"}}') END"""
_FIELDS = "p_name AS title, p_type AS description, '[\"a\",\"b\"]' AS genre, CAST(NULL AS VARCHAR) AS developer, p_brand AS publisher, concat(1960 + p_size, '-01-02') AS release_date, CAST(NULL AS VARCHAR) AS players, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS rating"


@query(f"SELECT p_partkey, {_FIELDS} FROM part")
def answer_fields(spark, d):
    answers = spread(table(spark, d, "part")).withColumn("answer", F.expr(_ANSWER))
    return answers.withColumn("found", P.answer_struct(F.col("answer"))).select("p_partkey", "found.*")


# One answer for each customer: ids of nations, of which its include block names one and one has an empty name.
_INCLUDE = """concat('{"include":{"genres":{"data":{"', n_nationkey, '":{"id":1,"name":"', n_name, '"},"98":{"name":""}}}},"data":{"game":{"genre":"","genres":[', n_nationkey, ',98,null,"",', n_nationkey + 1, '],"developers":[],"developer":[7,8],"publishers":[null],"publisher":"p"}}}')"""


@query("SELECT c_custkey, concat(n_name, ', 98, ', n_nationkey + 1) AS genre, '7, 8' AS developer, CAST(NULL AS VARCHAR) AS publisher FROM customer JOIN nation ON n_nationkey = c_nationkey")
def included_names(spark, d):
    j = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("answer", F.expr(_INCLUDE))
    game, answer = F.get_json_object("answer", "$.data.game"), F.col("answer")
    named = lambda block, *keys: P.listed_names(game, list(keys), P.include_names(answer, block))
    return j.select("c_custkey", named("genres", "genre", "genres").alias("genre"), named("developers", "developers", "developer").alias("developer"), named("publishers", "publishers", "publisher").alias("publisher"))


_LEFT = """CASE WHEN event_id % 5 = 0 THEN '{"code":200}' WHEN event_id % 41 = 0 THEN '{"remaining_monthly_allowance":0}' ELSE concat('{"remaining_monthly_allowance":', event_id % 41, '}') END"""


@query(
    "WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 41 END AS remaining FROM events),"
    " z AS (SELECT *, count(*) FILTER (WHERE remaining <= 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM r) SELECT user_id, event_id, remaining FROM z WHERE spent = 0"
)
def allowance_cut(spark, d):
    answers = table(spark, d, "events").select("user_id", "event_id", P.allowance(F.expr(_LEFT)).alias("remaining"))
    return P.until_exhausted(answers, "user_id", "event_id")


_NO = "CAST(NULL AS VARCHAR)"
_SIBLING = f"SELECT p_partkey AS id, 'launchbox' AS source, p_name AS title, {_NO} AS description, p_type AS genre, {_NO} AS developer, {_NO} AS publisher, {_NO} AS release_date, CAST(1999 AS INT) AS release_year, {_NO} AS players, {_NO} AS rating FROM part WHERE p_size % 11 = 0"
_SOURCES = (
    f"s AS ({_SIBLING}),"
    f" l AS (SELECT p_partkey, 'libretro_metadat', {_NO}, {_NO}, CASE WHEN p_size % 2 = 0 THEN p_type END, {_NO}, {_NO}, {_NO}, CASE WHEN p_size >= 10 AND p_size % 9 < 3 THEN 1960 + p_size END, {_NO}, {_NO} FROM part WHERE p_size % 3 = 0 AND (p_size % 2 = 0 OR (p_size >= 10 AND p_size % 9 < 3))),"
    f" g AS (SELECT p_partkey, 'gamedb', p_name, {_NO}, {_NO}, {_NO}, p_brand, {_NO}, CAST(NULL AS INT), {_NO}, {_NO} FROM part WHERE p_size % 5 = 0 AND p_size % 2 = 1),"
    f" h AS (SELECT p_partkey, 'hasheous', {_FIELDS.replace('AS release_date,', 'AS release_date, CAST(NULL AS INT) AS release_year,')} FROM part WHERE p_size % 7 = 0),"
    f" t AS (SELECT p_partkey, 'launchbox', {_NO}, p_type, {_NO}, {_NO}, p_brand, {_NO}, CAST(NULL AS INT), {_NO}, {_NO} FROM part WHERE p_size % 4 = 1)"
)


def _tiers(names: str) -> str:
    union = " UNION ALL ".join(f"SELECT {k} AS tier, * FROM {n}" for k, n in enumerate(names))
    return f"WITH {_SOURCES} SELECT * EXCLUDE (tier) FROM ({union}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1"


def _found(spark, d):
    part = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    no, has = F.lit(None).cast("string"), lambda c: part.where(c)
    sibling = has("p_size % 11 = 0").select("id", F.lit("launchbox").alias("source"), *(c.cast(P.PAYLOAD[n]).alias(n) for n, c in ({n: no for n in P.PAYLOAD} | {"title": F.col("p_name"), "genre": F.col("p_type"), "release_year": F.lit(1999)}).items()))
    dimensions = has("p_size % 3 = 0").select("id", F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END").alias("genre"), F.lit("").alias("developer"), no.alias("publisher"), no.alias("maxusers"), no.alias("esrb"), F.expr("CASE WHEN p_size % 9 < 3 THEN string(1960 + p_size) ELSE 'unknown' END").alias("releaseyear"))
    index = has("p_size % 5 = 0").select("id", F.col("p_name").alias("title"), F.expr("CASE WHEN p_size % 2 = 1 THEN p_brand ELSE '' END").alias("publisher"), F.lit("").alias("release_date"))
    titles = has("p_size % 4 = 1").select("id", F.col("p_type").alias("description"), no.alias("genre"), no.alias("developer"), F.col("p_brand").alias("publisher"), no.alias("release_date"), no.alias("players"), no.alias("rating"))
    answers = part.select("id", F.expr(f"CASE WHEN p_size % 7 = 0 THEN {_ANSWER} END").alias("answer"))
    return {"sibling": sibling, "libretro_metadat": P.dimension_payload(dimensions).withColumn("developer", F.nullif("developer", F.lit(""))), "gamedb": P.index_payload(index), "hasheous": P.answer_payload(answers, "answer"), "launchbox": P.title_payload(titles)}


@query(_tiers("slght"))
def provider_payloads(spark, d):
    return P.first_payload(_found(spark, d))


@query(_tiers("slgt"))
def provider_payloads_offline(spark, d):
    return P.first_payload(_found(spark, d), online=False)


@query(
    "WITH c AS (SELECT doc_id AS id, 'Named_Snaps' AS cover_type FROM labels WHERE quality = 0), s AS (SELECT doc_id AS id, doc_id * 10 AS cover_id FROM labels WHERE toxic = 1)"
    " SELECT id, cover_id, NULL AS cover_type FROM s UNION ALL SELECT doc_id, NULL, t.cover_type FROM documents, (VALUES ('Named_Boxarts'), ('Named_Snaps'), ('Named_Titles')) t(cover_type) WHERE lang <> 'de' AND n_chars % 3 <> 0 AND doc_id NOT IN (SELECT id FROM s) AND (doc_id, t.cover_type) NOT IN (SELECT id, cover_type FROM c)"
)
def cover_steps(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN lang <> 'de' THEN lang END").alias("system_id"), F.expr("CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'x' END").alias("canonical_name"))
    siblings = labels.where("toxic = 1").select("id", (F.col("id") * 10).alias("cover_id"))
    return P.cover_steps(items, siblings, labels.where("quality = 0").select("id", F.lit("Named_Snaps").alias("cover_type")))
