"""The generic transforms that most catalogue operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order; combined before the shuffle. Rows with a null key go."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order))).alias("_order"), F.struct(*rest).alias("_row"))
    return ranked.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row")).select(*keys, "_row.*")


def tier_ladder(left: DataFrame, tiers: list[tuple[DataFrame, list[str]]], values: list[str]) -> DataFrame:
    """left with ``values`` of the first tier that has its keys, and match_tier (1, 2, ... or null).

    Each tier's side has one row for each key at most (see first_wins) and columns keys + values.
    """
    out = left
    for n, (side, keys) in enumerate(tiers, start=1):
        own = side.select(*(F.col(k).alias(f"_k{n}_{k}") for k in keys), F.struct(*values).alias(f"_t{n}"))
        cond = None
        for k in keys:
            c = out[k] == own[f"_k{n}_{k}"]
            cond = c if cond is None else cond & c
        out = out.join(own, cond, "left").drop(*(f"_k{n}_{k}" for k in keys))
    hit = F.coalesce(*(F.col(f"_t{n + 1}") for n in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.col(f"_t{n + 1}").isNotNull(), n + 1) for n in range(len(tiers))))
    return out.select(*left.columns, *(hit[v].alias(v) for v in values), tier.alias("match_tier"))


def keeper(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """df with is_keeper and the keeper's columns (as keeper_*) on every row. The keeper is found by aggregation and joined back, so large groups can be split."""
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_keep"), F.count("*").alias("group_size"))
    out = df.join(ranked, keys)
    return out.select(*df.columns, "group_size", *(F.col(f"_keep.{c}").alias(f"keeper_{c}") for c in columns))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with columns l_*, r_* and side: both, left or right."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full").withColumn("side", side)


def latest_distinct(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The n keys that were seen last."""
    return df.groupBy(key).agg(F.max(time).alias(time)).orderBy(F.desc(time), F.asc(key)).limit(n)


def preferred_first(df: DataFrame, group: list[str], flag: str, key: str) -> DataFrame:
    """If no row of a group is flagged, the one with the least key is."""
    w = Window.partitionBy(*group)
    return df.withColumn(flag, F.when((F.max(F.col(flag)).over(w) == 0) & (F.col(key) == F.min(key).over(w)), 1).otherwise(F.col(flag)))


def contained_pick(items: DataFrame, group: str, text: str, key: str, least: int = 12) -> DataFrame:
    """key and pick: the least other key of the group whose text is equal or, both of ``least`` characters or more, contains this one or lies in it.

    Keys are unique; rows without such another have a null pick. Texts of a group aren't paired: substrings of a text that begin as some text
    of the group does are joined with the texts by equality. Texts are titles: the work grows with the square of their length, not of their number.
    """
    rows = items.select(F.col(group).alias("g"), F.col(text).alias("t"), F.col(key).alias("i"))
    first = rows.groupBy("g", "t").agg(F.min("i").alias("first"))
    rows = rows.join(first, ["g", "t"], "left")
    second = rows.where("i <> first").groupBy("g", "t").agg(F.min("i").alias("second"))
    long = first.where(F.length("t") >= least)
    heads = long.select("g", F.left("t", F.lit(least)).alias("head")).distinct()
    starts = long.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("t") - (least - 1)))).withColumn("head", F.substr("t", F.col("at"), F.lit(least)))
    starts = starts.join(heads, ["g", "head"], "left_semi")
    ends = F.sequence(F.lit(least), F.length("t") - F.col("at") + 1)
    parts = starts.select("g", "t", "first", F.explode(F.transform(ends, lambda n: F.substr("t", F.col("at"), n))).alias("part")).where("part <> t")
    hits = parts.join(long.select("g", F.col("t").alias("part"), F.col("first").alias("inner")), ["g", "part"])
    near = hits.select("g", "t", F.col("inner").alias("near")).unionByName(hits.select("g", F.col("part").alias("t"), F.col("first").alias("near")))
    near = near.groupBy("g", "t").agg(F.min("near").alias("near"))
    out = rows.join(second, ["g", "t"], "left").join(near, ["g", "t"], "left")
    own = F.when(F.col("i") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return out.select(F.col("i").alias(key), F.least(own, "near").alias("pick"))
