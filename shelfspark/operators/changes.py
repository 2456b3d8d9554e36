"""Partial updates: changes that name only the fields they set, as maps, so that "set to nothing" differs from "left alone"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and fields: of several changes of a row the last one that names a field sets it. changes: keys, order, fields (map of name to text, null to clear)."""
    each = changes.select(*keys, F.col(order).alias("_at"), F.explode("fields").alias("_name", "_value"))
    # a null value must survive the aggregation, so it travels in a struct
    last = each.groupBy(*keys, "_name").agg(F.max_by(F.struct("_value"), "_at").alias("_set"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_set._value"))).alias("fields"))


def changed(old: DataFrame, changes: DataFrame, keys: list[str], *, insert: bool = False, keep_nulls: bool = False, stamps: dict[str, Column] | None = None) -> DataFrame:
    """The next table: fields that a row's change names take its values, the others stay.

    changes: keys, fields (one row for each key, see gathered); values are cast to their columns, names that old hasn't are ignored. insert: keys that old
    hasn't become rows. keep_nulls: a null leaves the old value (an upsert that coalesces). stamps: columns that rows with a change get, as a clock that the
    caller gives.
    """
    o, c = old.alias("o"), changes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("fields").alias("_fields")).alias("c")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"o.{k}") == F.col(f"c._{k}")
    j = o.join(c, same, "full" if insert else "left")
    met = F.col("_fields").isNotNull()
    out = []
    for name in old.columns:
        kind = old.schema[name].dataType
        own = F.col(f"o.{name}")
        if name in keys:
            value = F.coalesce(own, F.col(f"c._{name}"))
        elif stamps and name in stamps:
            value = F.when(met, stamps[name].cast(kind)).otherwise(own)
        else:
            new = F.col("_fields")[name].cast(kind)
            value = F.coalesce(new, own) if keep_nulls else F.when(F.coalesce(F.map_contains_key("_fields", F.lit(name)), F.lit(False)), new).otherwise(own)
        out.append(value.alias(name))
    return j.select(*out)
