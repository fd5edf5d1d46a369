"""Exponential histograms in closed form.

The structure merges by counts only, so after n rows it is an exact aggregate of the last m(n) rows, and the first row that it
still holds moves in steps of 2^L: it always begins a block of 2^L rows. The value of a row is therefore that of its own block so
far and of the few whole blocks before it: sums begin anew in each block, so no early value disturbs a later one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions.columns import private
from rillgraph.operators.windows import ORDER, key_window, merged_deviation

MOST = 10_000_000


def shape(n: int, k: int = 2) -> tuple[int, int]:
    """(levels, capacity): the fewest levels that hold more than n items, with k + 2 boxes below and k // 2 + 2 above."""
    if not 0 < n < MOST:
        raise ValueError(f"window of {n} items: out of range")
    if k < 1:
        raise ValueError("k must be positive")
    levels = 1
    while (capacity := (k + 2) + (k // 2 + 2) * (2**levels - 2)) <= n:
        levels += 1
    return levels, capacity


def held(rows: int, n: int, k: int = 2) -> int:
    """How many of the latest rows the histogram covers after that many."""
    levels, capacity = shape(n, k)
    return rows if rows <= capacity else rows - 2**levels * ((rows - capacity - 1) // 2**levels + 1)


def features(df: DataFrame, value: Column | str, n: int, k: int, keys: Sequence[str], names: dict[str, str], order: Sequence[str] = ORDER) -> DataFrame:
    """df with the features in names (op in sum, ave, var -> column name). Null values count as 0; var is of the population.

    Running sums (and Welford's squared deviations) inside a block, and the totals of at most capacity / 2^L blocks before
    it, each carried along the key by one window function: a row costs the same whatever n.
    """
    levels, capacity = shape(n, k)
    step = 1 << levels
    blocks = (capacity - 1) // step
    v, i, b, m = private(df, "value", "row", "block", "held")
    s, q = ([f"{x}_{j}" for j in range(blocks + 1)] for x in private(df, "sums", "squares"))
    w, var = key_window(keys, order), "var" in names
    d = df.withColumns({v: F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(0.0)), i: F.row_number().over(w)})
    row = F.col(i)
    d = d.withColumn(b, F.floor((row - 1) / step).cast("long"))
    inside = Window.partitionBy(*(keys or [F.lit(0)]), b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({s[0]: F.sum(v).over(inside)} | ({q[0]: F.var_pop(v).over(inside) * (row - F.col(b) * step)} if var else {}))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for j in range(1, blocks + 1):  # what the last row of the block before had: its total, then the totals further back
        d = d.withColumns({x[j]: F.last(F.when(row % step == 0, F.col(x[j - 1])), ignorenulls=True).over(before) for x in ((s, q) if var else (s,))})
    d = d.withColumn(m, F.when(row <= capacity, row).otherwise(row - step * (F.floor((row - capacity - 1) / step) + 1)))
    back = F.floor((F.col(m) - 1) / step)  # whole blocks that are held besides the row's own
    total = F.col(s[0])
    for j in range(1, blocks + 1):
        total = total + F.when(back >= j, F.col(s[j])).otherwise(0.0)
    made = {"sum": total, "ave": total / F.col(m)}
    if var:
        parts = [((row - F.col(b) * step), F.col(s[0]), F.col(q[0]))] + [(F.when(back >= j, F.lit(step)).otherwise(0), F.when(back >= j, F.col(s[j])).otherwise(0.0), F.when(back >= j, F.col(q[j])).otherwise(0.0)) for j in range(1, blocks + 1)]
        made["var"] = merged_deviation(parts) / F.col(m)
    out = df.columns
    return d.withColumns({name: made[op] for op, name in names.items()}).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*out, *names.values()])])
