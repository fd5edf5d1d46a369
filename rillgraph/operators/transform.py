"""Filter, transform, project and collapse."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions.columns import private
from rillgraph.operators.windows import ORDER, key_window


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; unknown drops the row."""
    return df.filter(condition)


def flag(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """The condition as a boolean feature."""
    return df.withColumn(name, condition)


def previous(value: str, keys: Sequence[str], i: int = 1, order: Sequence[str] = ORDER) -> Column:
    return F.lag(value, i).over(key_window(keys, order))


def transform(df: DataFrame, name: str, expression: Column, keys: Sequence[str], carry: Sequence[str] = ("edge_id", "ts")) -> DataFrame:
    """A derived stream (carry..., keys..., name); where the expression is undefined its value is 0 and the row stays."""
    return df.select(*carry, *keys, F.coalesce(expression.cast("double"), F.lit(0.0)).alias(name))


def time_lapse(df: DataFrame, time: str, keys: Sequence[str], name: str = "TimeDiff", order: Sequence[str] = ORDER) -> DataFrame:
    """Seconds since the key's previous row."""
    return transform(df, name, F.col(time) - previous(time, keys, 1, order), keys)


def project_latest(df: DataFrame, feature: str, keep_keys: Sequence[str], drop_key: str, order: Sequence[str] = ORDER) -> DataFrame:
    """(keep keys, map of dropped key -> latest feature): pre-aggregated max_by over the pairs, then one map for each key."""
    at = F.struct(*order)
    pairs = df.groupBy(*keep_keys, drop_key).agg(F.max_by(feature, at).alias("_f"))
    return pairs.groupBy(*keep_keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(drop_key).cast("string"), F.col("_f").cast("double"))))).alias(feature))


def collapse_map(df: DataFrame, name: str, feature: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Any aggregate of a map feature's values; fn gets them as an array."""
    return df.withColumn(name, fn(F.map_values(feature)))


def collapse(df: DataFrame, feature: str, keep_keys: Sequence[str], drop_key: str, mean: str | None = None, var: str | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """df with the mean (and population variance) over the latest feature of each pair that shares the kept keys, as of each
    row: a running sum of changes over a running count of pairs."""
    pair = Window.partitionBy(*keep_keys, drop_key).orderBy(*order)
    group = Window.partitionBy(*keep_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    f = F.col(feature).cast("double")
    d = df.withColumns({"_was": F.lag(f).over(pair), "_new": (F.row_number().over(pair) == 1).cast("long")})
    was = F.coalesce("_was", F.lit(0.0))
    d = d.withColumns({"_c": F.sum("_new").over(group), "_s": F.sum(f - was).over(group), "_q": F.sum(f * f - was * was).over(group)})
    if mean:
        d = d.withColumn(mean, F.col("_s") / F.col("_c"))
    if var:
        d = d.withColumn(var, F.greatest(F.lit(0.0), F.col("_q") / F.col("_c") - (F.col("_s") / F.col("_c")) * (F.col("_s") / F.col("_c"))))
    return d.drop("_was", "_new", "_c", "_s", "_q")


def lookup_latest(df: DataFrame, asked: DataFrame, feature: str, keys: Sequence[str], time: str = "ts", edge_id: str = "edge_id") -> DataFrame:
    """asked (keys, time, its own columns) with the feature that each key had at the time asked: that of the last row of df by
    (time, edge_id) not after it; null where there is none or its feature is null. A null key has no features.

    An as-of join as one ordered union: a window function carries the latest feature along the key, no range join."""
    mine, last, is_row = private(asked, "feature", "id", "row")
    rows = df.select(*keys, F.col(time), F.struct(F.col(feature)).alias(mine), F.col(edge_id).cast("long").alias(last), F.lit(0).alias(is_row))
    d = rows.unionByName(asked.withColumn(is_row, F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, is_row, last).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.last(mine, ignorenulls=True).over(w)[feature])
    return d.withColumn(mine, found).where(F.col(is_row) == 1).select(*[F.col(f"`{c}`") for c in asked.columns if c != feature], F.col(mine).alias(feature))


def subtuple(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def within_ttl(df: DataFrame, key: str, time: str, ttl: float) -> DataFrame:
    """df with `alive`: was the key seen within the last ttl seconds before this row (each sighting refreshes it)?"""
    last = F.lag(time).over(Window.partitionBy(key).orderBy(time, "edge_id"))
    return df.withColumn("alive", F.coalesce(F.col(time) - last <= ttl, F.lit(False)))
