"""What metadata providers say: fields of their answers, payloads of one form, and the ladder in which the first useful payload counts.

A payload is the columns of PAYLOAD. Answers are JSON texts; a field that holds an object or a list is its JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N
from shelfspark.operators.enrich import cover_fetches

# Fields of a payload, names that an answer may have for them, the order of the sources and those that need a network.
PAYLOAD = {"title": "string", "description": "string", "genre": "string", "developer": "string", "publisher": "string", "release_date": "string", "release_year": "int", "players": "string", "rating": "string"}
SYNONYMS = {
    "title": ["title", "name"],
    "description": ["description", "summary", "overview"],
    "genre": ["genre", "genres"],
    "developer": ["developer", "developers"],
    "publisher": ["publisher", "publishers"],
    "release_date": ["release_date", "first_release_date", "released"],
    "players": ["players", "max_players"],
    "rating": ["rating", "esrb"],
}
WRAPPERS = ["game", "data", "result"]
SOURCES = ["sibling", "libretro_metadat", "gamedb", "hasheous", "launchbox", "screenscraper", "thegamesdb"]
ONLINE = ["hasheous", "screenscraper", "thegamesdb"]
DIMENSION_FIELDS = {"genre": "genre", "developer": "developer", "publisher": "publisher", "maxusers": "players", "esrb": "rating"}
YEARS = (1970, 2100)


def _filled(c: Column) -> Column:
    return N.bound(c, lambda v: F.nullif(v, F.lit("")))


def _object(json: Column, path: str) -> Column:
    """The JSON text at a path if it is an object."""
    return N.bound(F.get_json_object(json, path), lambda value: F.when(F.startswith(value, F.lit("{")), value))


def answer_fields(json: Column) -> dict[str, Column]:
    """The fields of an answer, which may lie in one of the wrappers: each under the first of its names that isn't empty."""
    found = answer_struct(json)
    return {field: found[field] for field in SYNONYMS}


def answer_struct(json: Column) -> Column:
    """The same fields as one struct, for which the wrappers are looked for once; a column of it by itself serves any number of fields."""
    game = F.coalesce(*(_object(json, f"$.{w}") for w in WRAPPERS), json)
    named = lambda g, names: F.coalesce(*(_filled(F.get_json_object(g, f"$.{n}")) for n in names))
    return N.bound(game, lambda g: F.struct(*(named(g, names).alias(field) for field, names in SYNONYMS.items())))


def include_names(json: Column, block: str) -> Column:
    """id to name as the include block of an answer has them, within its data or beside it; the first place that has any."""

    def names(at: str) -> Column:
        entries = F.from_json(F.coalesce(_object(json, f"{at}.data"), _object(json, at)), "map<string,struct<name:string>>")
        named = F.map_filter(entries, lambda _, e: e["name"] != "")
        return N.bound(named, lambda m: F.transform_values(F.when(F.size(m) > 0, m), lambda _, e: e["name"]))

    return F.coalesce(names(f"$.data.include.{block}"), names(f"$.include.{block}"))


def listed_names(game: Column, keys: list[str], names: Column) -> Column:
    """The first of a game's fields that isn't empty; of a list its ids' names, or ids without a name as they are, joined by ', '. names is read once for a list, not for each id."""

    def listed(value: Column) -> Column:
        ids = F.filter(F.from_json(value, "array<string>"), lambda i: i != "")
        return N.bound(names, lambda m: _filled(F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(m, i), i)), ", ")))

    def first(at: Column, keys: list[str]) -> Column:
        if not keys:
            return F.lit(None).cast("string")
        text = lambda v: F.when(F.startswith(v, F.lit("[")), listed(v)).otherwise(v)
        return N.bound(F.get_json_object(at, f"$.{keys[0]}"), lambda v: F.when(F.coalesce(v, F.lit("")).isin("", "[]"), first(at, keys[1:])).otherwise(text(v)))

    return N.bound(game, lambda g: first(g, keys))


def allowance(json: Column) -> Column:
    """How many calls an answer says are left, null if it doesn't say."""
    return F.get_json_object(json, "$.remaining_monthly_allowance").try_cast("long")


def until_exhausted(answers: DataFrame, run: str, place: str) -> DataFrame:
    """Answers (run, place, remaining) of the calls that a run makes: up to the first that leaves no allowance; an unknown one lets it go on."""
    last = answers.where("remaining <= 0").groupBy(run).agg(F.min(place).alias("_last"))
    return answers.join(last, run, "left").where(F.col("_last").isNull() | (F.col(place) <= F.col("_last"))).drop("_last")


def _payload(entries: DataFrame, key: str, **fields: Column) -> DataFrame:
    return entries.select(key, *((fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in PAYLOAD.items()))


def _useful(payload: DataFrame, fields: list[str]) -> DataFrame:
    """Only payloads that say something of these fields."""
    return payload.where(F.coalesce(*(_filled(F.col(n).cast("string")) for n in fields)).isNotNull())


def dimension_payload(entries: DataFrame, key: str = "id") -> DataFrame:
    """Of an index of dimensions (key, genre, developer, publisher, maxusers, esrb, releaseyear); entries with none of them go."""
    year = F.col("releaseyear").try_cast("int")
    fields = {field: F.col(dimension) for dimension, field in DIMENSION_FIELDS.items()}
    out = _payload(entries, key, **fields, release_year=F.when(year.between(*YEARS), year))
    return _useful(out, [*DIMENSION_FIELDS.values(), "release_year"])


def index_payload(entries: DataFrame, key: str = "id") -> DataFrame:
    """Of entries of an index (key, title, publisher, release_date); those with a title alone go."""
    date = _filled(F.col("release_date"))
    out = _payload(entries, key, title=F.col("title"), publisher=_filled(F.col("publisher")), release_date=date, release_year=N.release_year(date))
    return _useful(out, ["publisher", "release_date", "release_year"])


def title_payload(entries: DataFrame, key: str = "id") -> DataFrame:
    """Of records of a title file; any record will do."""
    return _payload(entries, key, **{n: F.col(n) for n in ("description", "genre", "developer", "publisher", "release_date", "players", "rating")})


def answer_payload(answers: DataFrame, json: str, key: str = "id") -> DataFrame:
    """Of answers to a lookup by hash; null answers go."""
    found = answers.where(F.col(json).isNotNull()).withColumn("_found", answer_struct(F.col(json)))
    return _payload(found, key, **{field: F.col("_found")[field] for field in SYNONYMS})


def first_payload(found: dict[str, DataFrame], *, key: str = "id", online: bool = True) -> DataFrame:
    """key, source and payload of each item that any source knows, from the first of SOURCES that does.

    found: payloads by source, one row for each item at most; siblings' have the source that they came from. Without a network the
    sources of ONLINE are left out. All sources are put together and combined before one shuffle, instead of a join for each.
    """
    rows = []
    for rank, name in enumerate(SOURCES):
        if name in found and (online or name not in ONLINE):
            own = found[name] if name == "sibling" else found[name].withColumn("source", F.lit(name))
            rows.append(own.select(key, F.lit(rank).alias("_rank"), F.struct("source", *PAYLOAD).alias("_found")))
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min_by("_found", "_rank").alias("_found")).select(key, "_found.*")


def cover_steps(items: DataFrame, siblings: DataFrame, covers: DataFrame) -> DataFrame:
    """id, cover_id, cover_type: a cover to copy (cover_id) for each that an item's siblings have, else each missing type to fetch (cover_type).

    items: id, system_id, canonical_name (without both nothing can be fetched); siblings: id, cover_id; covers: id, cover_type.
    """
    copied = siblings.join(items.select("id"), "id", "left_semi").select("id", "cover_id", F.lit(None).cast("string").alias("cover_type"))
    alone = items.where("system_id <> '' AND canonical_name <> ''").join(siblings.select("id"), "id", "left_anti")
    fetched = cover_fetches(alone, covers).select("id", F.lit(None).cast(siblings.schema["cover_id"].dataType).alias("cover_id"), "cover_type")
    return copied.unionByName(fetched)
