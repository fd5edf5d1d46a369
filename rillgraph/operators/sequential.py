"""Operators whose state depends on each row in turn, and set comparisons over a window."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.functions.columns import private
from rillgraph.operators import windows
from rillgraph.operators.windows import ORDER, key_window


def similarity(df: DataFrame, name: str, value: str, n: int, keys: Sequence[str], order: Sequence[str] = ORDER, ranges: int = 0) -> DataFrame:
    """Jaccard index of the two physical halves of a ring of n slots that starts as zeros: row i fills slot (i - 1) mod n.
    Null values count as 0.

    Counted, not gathered: the low half holds the last n // 2 rows that fell into it, so its distinct values are those of a
    window over these rows alone (carried along the rows of the other half); the high half likewise; their union is the
    window of n rows. A zero that a slot began with counts until the half is full. A row costs the same whatever n.
    With `ranges` rows are numbered in so many ranges of the order (windows.place) and counted in blocks of n, so that no task
    holds a whole key.
    """
    if n == 1:  # all lies in one half
        return df.withColumn(name, F.lit(0.0))
    half = n // 2
    v, i, low, some, a, b, u = private(df, "filled", "place", "low", "zeros", "own", "other", "union")
    w = key_window(keys, order)
    d = df.withColumns({v: F.coalesce(F.col(value).cast("double"), F.lit(0.0)) + 0.0})  # -0.0 is 0.0
    d = windows.place(d, i, keys, order, ranges).withColumn(i, F.col(i) + 1) if ranges else d.withColumn(i, F.row_number().over(w))
    d = d.withColumn(low, (F.col(i) - 1) % n < half)
    if ranges:
        place, sub, block, again = private(d, "from_zero", "in_half", "block", "again")
        own_half, slot = F.when(F.col(low), half).otherwise(n - half), (F.col(i) - 1) % n
        d = d.withColumns({place: F.col(i) - 1, sub: F.floor((F.col(i) - 1) / n) * own_half + slot - F.when(F.col(low), 0).otherwise(half)})
        d = windows.distinct_placed(d, a, F.col(v), own_half, [*keys, low], sub)
        d = windows.distinct_placed(d, u, F.col(v), F.lit(n), keys, place)
        d = d.withColumn(again, F.explode(F.when(slot == n - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))  # a block begins with the last row before it
        d = d.withColumn(block, F.floor((F.col(i) - 1) / n) + F.col(again))
        so_far = Window.partitionBy(*keys, block).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    else:
        d = windows.distinct(d, a, F.col(v), half, [*keys, low], order)
        if n % 2:  # the high half has a slot more
            d = windows.distinct(d, b, F.col(v), half + 1, [*keys, low], order).withColumn(a, F.when(F.col(low), F.col(a)).otherwise(F.col(b)))
        d = windows.distinct(d, u, F.col(v), n, keys, order)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sizes = []
    for is_low, full in ((F.col(low), half), (~F.col(low), n)):
        count = F.coalesce(F.last(F.when(is_low, F.col(a)), ignorenulls=True).over(so_far), F.lit(0))
        zero = F.coalesce(F.max(is_low & (F.col(v) == 0.0)).over(so_far), F.lit(False))
        sizes.append((count, zero, F.col(i) < full))
    d = d.withColumns({b: F.array(*[c + (first & ~z).cast("long") for c, z, first in sizes]), some: sizes[0][1] | sizes[1][1]})
    d = d.where(F.col(again) == 0) if ranges else d
    union = F.col(u) + ((F.col(i) < n) & ~F.col(some)).cast("long")
    return d.withColumn(name, (F.get(b, F.lit(0)) + F.get(b, F.lit(1)) - union) / union).select(*windows.kept(df, name))


class RotatingDistinct:
    """Five sets in rotation: a value counts if no set has it; every n // 5 rows the next set is cleared. A repeat doesn't
    refresh a value, so it is forgotten with the set that first took it."""

    def __init__(self, n: int, parts: int = 5):
        self.sets, self.at, self.rows, self.every = [set() for _ in range(parts)], 0, 0, n // parts

    def add(self, v) -> int:
        if not any(v in s for s in self.sets):
            self.sets[self.at].add(v)
        self.rows += 1
        out = sum(map(len, self.sets))
        if self.rows >= self.every:
            self.at, self.rows = (self.at + 1) % len(self.sets), 0
            self.sets[self.at].clear()
        return out


def rotating_distinct(df: DataFrame, name: str, value: str, n: int, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """df with the rotating count of distinct values. A key's rows pass one Python object in order, a run at a time."""
    return _in_order(df, name, value, keys, order, lambda: RotatingDistinct(n).add, T.LongType())


def kmedian(df: DataFrame, name: str, value: str, n: int, k: int, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """df with the k medians (array<double>) of each row's last n values: Lloyd's iteration with absolute distances."""

    def step():
        ring: deque = deque(maxlen=n)

        def add(v):
            ring.append(float(v or 0))
            s = sorted(ring)
            if k == 1 or len(s) <= k:
                return [median(s)] if k == 1 else s
            c = [s[(2 * i + 1) * len(s) // (2 * k)] for i in range(k)]
            for _ in range(20):
                near: list[list[float]] = [[] for _ in c]
                for x in s:
                    near[min(range(k), key=lambda i: (abs(x - c[i]), i))].append(x)
                new = [median(g) if g else c[i] for i, g in enumerate(near)]
                if new == c:
                    break
                c = new
            return sorted(c)

        return add

    return _in_order(df, name, value, keys, order, step, T.ArrayType(T.DoubleType()))


def median(s: list[float]) -> float:
    h = len(s) // 2
    return s[h] if len(s) % 2 else (s[h - 1] + s[h]) / 2


def _in_order(df, name, value, keys, order, begin, kind) -> DataFrame:
    names = list(keys)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches):
        """Partitions are clustered and sorted by key; state lives for one key at a time, whatever its number of rows."""
        last, f = None, None
        for pdf in batches:
            out = []
            rows = zip(*(pdf[c] for c in names), strict=True) if names else ((),) * len(pdf)
            for key, v in zip(rows, pdf[value], strict=True):
                key = tuple(None if x != x else x for x in key)
                if f is None or key != last:
                    last, f = key, begin()
                out.append(f(v))
            yield pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object if isinstance(kind, T.ArrayType) else "int64")})

    spread = df.repartition(*[F.col(c) for c in names]) if names else df.repartition(1)
    return spread.sortWithinPartitions(*names, *order).mapInPandas(run, schema)
