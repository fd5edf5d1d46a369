"""Block top-k: windows of frozen blocks, of which each keeps its own most frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.windows import ORDER, key_window, place


def dormant(n: int, b: int) -> int:
    """How many frozen blocks a window of n rows in blocks of b keeps."""
    if n <= 0 or b <= 0 or n // b - 1 <= 0:
        raise ValueError(f"window {n} and block {b} leave no frozen block")
    return n // b - 1


def topk(df: DataFrame, name: str, value: str, n: int, b: int, k: int, keys: Sequence[str], order: Sequence[str] = ORDER, ranges: int = 0) -> DataFrame:
    """df with `name`: array<struct<key, frequency>>, by frequency down, then key; null until a block of the key is frozen.

    Counted once for each (key, block), not for each row: a block's top k are ranked, handed to the windows that retain the
    block (at most N / b of them), summed there, and joined back on (key, number of frozen blocks). With `ranges` a key's rows
    are numbered in so many ranges of the order (windows.place), so that no task holds a whole key.
    """
    held = dormant(n, b)
    ks = [F.col(c) for c in keys] or [F.lit(0)]
    names = [f"_k{i}" for i in range(len(ks))]
    d = place(df, "_n", keys, order, ranges).withColumn("_n", F.col("_n") + 1) if ranges else df.withColumn("_n", F.row_number().over(key_window(keys, order)))
    d = d.withColumns(dict(zip(names, ks, strict=True)))
    d = d.withColumn("_b", F.floor((F.col("_n") - 1) / b).cast("long"))
    counts = d.groupBy(*names, "_b", F.col(value).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_b").orderBy(F.col("_c").desc(), "_v"))).where(F.col("_r") <= k)
    spread = ranked.withColumn("_d", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + held)))
    sums = spread.groupBy(*names, "_d", "_v").agg(F.sum("_c").alias("_c"))
    share = F.col("_c") / (F.least(F.col("_d"), F.lit(held)) * b)
    lists = sums.groupBy(*names, "_d").agg(F.sort_array(F.collect_list(F.struct((-share).alias("o"), F.col("_v").alias("key"), share.alias("frequency")))).alias("_l"))
    lists = lists.select(*[F.col(c).alias(f"_j{c}") for c in names], F.col("_d").alias("_jd"), F.transform("_l", lambda x: F.struct(x["key"].alias("key"), x["frequency"].alias("frequency"))).alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in names] + [F.col("_b") == F.col("_jd")]
    return d.join(lists, on, "left").drop(*names, *[f"_j{c}" for c in names], "_jd", "_n", "_b")


def value_at(name: str, i: int):
    """Frequency at place i; null past the end, so that a filter drops the row."""
    return F.get(F.col(name), F.lit(i))["frequency"]


def keys_of(name: str):
    return F.transform(F.col(name), lambda x: x["key"])
