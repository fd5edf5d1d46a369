"""Per-key count windows: each row gets the value over the last N rows of its key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rillgraph.functions.columns import private

ORDER = ("ts", "edge_id")


def key_window(keys: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    """Rows of a key in total order; no keys: one global group."""
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)


def last_rows(n: int, keys: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    if n < 1:
        raise ValueError(f"a window of {n} rows")
    return key_window(keys, order).rowsBetween(-(n - 1), 0)


#: name -> (value column, window of the last N rows) -> value
EXACT: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "sum": lambda c, w: F.sum(c).over(w),
    "simplesum": lambda c, w: F.sum(c).over(w),
    "ave": lambda c, w: F.avg(c).over(w),
    "var": lambda c, w: F.var_pop(c).over(w),
    "stddev": lambda c, w: F.stddev_pop(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "median": lambda c, w: F.percentile(c, F.lit(0.5)).over(w),
    "count": lambda c, w: F.count(c).over(w),
    "countdistinct": lambda c, w: F.size(F.collect_set(c).over(w)).cast("long"),
    "approxdistinct": lambda c, w: _sketched(F.size(F.collect_set(_hash(c)).over(w)).cast("long"), c, w),
    "l2norm": lambda c, w: F.sqrt(F.sum(c * c).over(w)),
    "rarity": lambda c, w: _rarity(F.collect_list(c).over(w)),
}


#: Hashes that the distinct sketch holds one by one before it turns to registers: as many bits as its 512 registers of 6.
SPARSE = 48


def _hash(c: Column) -> Column:
    return F.when(c.isNotNull(), F.xxhash64(c))


def _sketched(held: Column, c: Column, w: WindowSpec) -> Column:
    """HyperLogLog++ with its sparse form, which Spark's lacks: among 512 registers even ten values share some now and then."""
    return F.when(held <= SPARSE, held).otherwise(F.approx_count_distinct(c).over(w))


def _rarity(values: Column) -> Column:
    """The share of the distinct values that occur once; null without values. Costs a comparison for each pair of values."""
    different = F.array_distinct(values)
    once = F.filter(different, lambda v: F.size(F.filter(values, lambda u: u == v)) == 1)
    return F.size(once) / F.nullif(F.size(different), F.lit(0))


def register_operator(name: str, fn: Callable[[Column, WindowSpec], Column]) -> None:
    """Add a window operator under a name that the builder and the query language accept."""
    EXACT[name] = fn


#: Windows of more rows are computed from blocks, at a cost for each row that doesn't depend on n; smaller ones by frames.
FRAME = 32
#: Rows of a chain that one task holds at a time, where a key is spread.
CHUNK = 1 << 16
BLOCKWISE = ("sum", "simplesum", "ave", "var", "stddev", "max", "min", "count", "l2norm", "countdistinct")


def exact(df: DataFrame, name: str, op: str, value: Column | str, n: int, keys: Sequence[str], order: Sequence[str] = ORDER, ranges: int | str = 0) -> DataFrame:
    """df with feature `name`. Equal (keys, order) share one exchange, whatever n. Nulls are left out, as in Spark's aggregates.

    A key's rows are sorted in one task. With `ranges` each key is parted into so many ranges of the order instead, and then
    into blocks of n rows: for the one group without keys, or keys that hold a large share of all rows. The result is the
    same; it costs a pass for the ranges and more exchanges. Several features share the pass if `ranges` names a column that
    place() has made."""
    c = F.col(value) if isinstance(value, str) else value
    if ranges:
        if op not in BLOCKWISE:
            raise ValueError(f"{op} isn't computed from blocks")
        if op != "countdistinct":
            return _blockwise(df, {name: op}, c, n, keys, order, ranges)
        (at,) = [ranges] if isinstance(ranges, str) else private(df, "place")
        d = df if isinstance(ranges, str) else place(df, at, keys, order, ranges)
        return distinct_placed(d, name, c, F.lit(n), keys, at).select(*kept(df, name))
    if n > FRAME and op in BLOCKWISE:
        return distinct(df, name, c, n, keys, order) if op == "countdistinct" else _blockwise(df, {name: op}, c, n, keys, order)
    if n > FRAME and op == "approxdistinct":
        (held,) = private(df, "held")
        d = distinct(df, held, _hash(c), n, keys, order)
        return d.withColumn(name, _sketched(F.col(held), c, last_rows(n, keys, order))).select(*kept(df, name))
    return df.withColumn(name, EXACT[op](c, last_rows(n, keys, order)))


def several(df: DataFrame, names: dict[str, str], value: Column | str, n: int, keys: Sequence[str], order: Sequence[str] = ORDER, ranges: int | str = 0) -> DataFrame:
    """df with a feature for each name -> op of one value, as exact() gives them one by one; the blocks are passed once for all."""
    return _blockwise(df, names, F.col(value) if isinstance(value, str) else value, n, keys, order, ranges)


def merged_deviation(parts: list[tuple[Column, Column, Column]]) -> Column:
    """Sum of squared deviations from the common mean, of parts (rows, sum, sum of squared deviations from their own mean)."""
    rows = [p[0] for p in parts]
    mean = sum((p[1] for p in parts[1:]), parts[0][1]) / F.nullif(sum(rows[1:], rows[0]), F.lit(0))
    each = [F.when(k > 0, q + k * (s / k - mean) * (s / k - mean)).otherwise(0.0) for k, s, q in parts]
    return sum(each[1:], each[0])


def place(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str] = ORDER, ranges: int = 64) -> DataFrame:
    """df with `name`: the place (from 0) of each row in its key, as a row number over the key would give.

    The first column of the order (a number or time) is cut at `ranges` quantiles, the same for all keys. Rows are numbered
    inside (key, range) and raised by the rows that the key has in the ranges before: a key of any size is spread, unless its
    rows share one value of that column. The ranges and their counts are all that is gathered."""
    at, all_, rows, before = private(df, "range", "all", "rows", "before")
    t = F.col(order[0]).cast("double")  # keeps the order; equal images stay together
    found = df.select(F.percentile_approx(t, [j / ranges for j in range(1, ranges)])).first()[0] if ranges > 1 else None
    cuts = sorted(set(found or []))

    def range_of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(t < cuts[mid], range_of(lo, mid)).otherwise(range_of(mid + 1, hi))

    ks = list(keys) or [all_]
    d = df.withColumns({at: F.when(t.isNull(), -1).otherwise(range_of(0, len(cuts))), all_: F.lit(0)})  # nulls come first
    counts = d.groupBy(*ks, at).agg(F.count(F.lit(1)).alias(rows))
    counts = counts.withColumn(before, F.coalesce(F.sum(rows).over(Window.partitionBy(*ks).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    other = [f"{x}_{j}" for j, x in enumerate(private(df, *["key"] * (len(ks) + 1)))]
    counts = counts.select(*[F.col(f"`{k}`").alias(o) for k, o in zip([*ks, at], other, strict=True)], before)
    d = d.withColumn(rows, F.row_number().over(Window.partitionBy(*ks, at).orderBy(*order)) - 1)
    d = d.join(counts, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in zip([*ks, at], other, strict=True)]))
    return d.withColumn(name, F.col(rows) + F.col(before)).select(*kept(df, name))


#: What the operators are made of: running aggregates of a value.
RUNNING = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "var": F.var_pop, "squares": lambda v: F.sum(v * v)}
PARTS = {"max": ["max"], "min": ["min"], "count": ["count"], "ave": ["count", "sum"], "var": ["count", "sum", "var"], "stddev": ["count", "sum", "var"], "l2norm": ["squares"], "sum": ["sum"], "simplesum": ["sum"]}


def _blockwise(df: DataFrame, names: dict[str, str], c: Column, n: int, keys: Sequence[str], order: Sequence[str], ranges: int | str = 0) -> DataFrame:
    """Blocks of n rows of a key: a window is the end of one block and the beginning of the next. Both are running aggregates
    inside the block, forwards and backwards, so nothing is subtracted and nothing is computed twice."""
    v, i, b = private(df, "value", "row", "block")
    ks = list(keys) or [F.lit(0)]
    w = key_window(keys, order)
    if isinstance(ranges, str):
        d = df.withColumn(i, F.col(ranges))
    else:
        d = place(df, i, keys, order, ranges) if ranges else df.withColumn(i, F.row_number().over(w) - 1)
    d = d.withColumns({v: c, b: F.floor(F.col(i) / n)})
    there = Window.partitionBy(*ks, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*ks, b).orderBy(*[F.desc(x) for x in order]).rowsBetween(Window.unboundedPreceding, 0)
    of = list(dict.fromkeys(x for op in names.values() for x in PARTS[op]))
    head, tail = (dict(zip(of, private(df, *[f"{side}_{x}" for x in of]), strict=True)) for side in ("head", "tail"))
    d = d.withColumns({head[x]: RUNNING[x](F.col(v)).over(there) for x in of})
    d = d.withColumns({tail[x]: RUNNING[x](F.col(v)).over(back) for x in of})
    whole = F.col(i) % n == n - 1  # the window is the row's own block
    if ranges and n > 1:  # every (n - 1)th row follows the other, in chunks of which each passes its last row on to the next
        again, chunk = private(d, "again", "chunk")
        step = F.floor(F.col(i) / (n - 1))
        d = d.withColumn(again, F.explode(F.when(step % CHUNK == CHUNK - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        d = d.withColumn(chunk, F.floor(step / CHUNK) + F.col(again))
        chain = Window.partitionBy(*ks, F.col(i) % (n - 1), chunk).orderBy(i)
        d = d.withColumns({x: F.when(~whole, F.lag(x).over(chain)) for x in tail.values()}).where(F.col(again) == 0)
    else:
        d = d.withColumns({x: F.when(~whole, F.lag(x, n - 1).over(w)) for x in tail.values()})
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    total = lambda x: F.when(F.col(head[x]).isNotNull() | F.col(tail[x]).isNotNull(), zero(head[x]) + zero(tail[x]))

    def made(op: str) -> Column:
        if op in ("max", "min"):
            return (F.greatest if op == "max" else F.least)(head[op], tail[op])  # both skip nulls
        if op == "ave":
            return F.when(total("count") > 0, total("sum") / total("count"))
        if op in ("var", "stddev"):
            parts = [(zero(x["count"]), zero(x["sum"]), zero(x["var"]) * zero(x["count"])) for x in (head, tail)]
            out = F.when(total("count") > 0, merged_deviation(parts) / total("count"))
            return F.sqrt(out) if op == "stddev" else out
        return F.sqrt(total("squares")) if op == "l2norm" else total(PARTS[op][0])

    return d.withColumns({name: made(op) for name, op in names.items()}).select(*[F.col(f"`{x}`") for x in dict.fromkeys([*df.columns, *names])])


def distinct_placed(df: DataFrame, name: str, c: Column, n: Column, keys: Sequence[str | Column], at: str) -> DataFrame:
    """distinct(), of rows whose places in their key (from 0) are known; no task holds more of a key, or of a value, than two
    blocks of n rows.

    Each row is also handed to the block after its own. There it counts if its block had no such value before it, which gives
    the window at the block's beginning, and leaves n places on unless its value comes again before."""
    v, b, own, p, q, on, first, i = private(df.withColumn(name, F.lit(0)), "value", "block", "own", "before", "after", "change", "first", "at")
    d = df.withColumns({v: c, own: F.explode(F.array(F.lit(1), F.lit(0)))})
    d = d.withColumn(b, F.floor(F.col(at) / n) + 1 - F.col(own))
    same = Window.partitionBy(*keys, b, v).orderBy(at)
    d = d.withColumns({p: F.lag(at).over(same), q: F.lead(at).over(same)})
    mine, some, row = F.col(own) == 1, F.col(v).isNotNull(), F.col(at)
    enters, leaves = F.col(p).isNull() | (F.col(p) <= row - n), F.col(q).isNull() | (F.col(q) >= row + n)
    d = d.withColumns({on: (some & F.when(mine, enters).otherwise(leaves)).cast("long"), first: (some & ~mine & F.col(p).isNull()).cast("long"), i: F.when(mine, row).otherwise(row + n)})
    so_far = Window.partitionBy(*keys, b).orderBy(i, own).rowsBetween(Window.unboundedPreceding, 0)
    change = F.sum(F.when(mine, F.col(on)).otherwise(-F.col(on))).over(so_far)
    return d.withColumn(name, F.sum(first).over(Window.partitionBy(*keys, b)) + change).where(mine).select(*kept(df, name))


def distinct(df: DataFrame, name: str, c: Column, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running sum of changes: a value enters with a row unless it occurs in the n - 1 rows before, and leaves with the row n
    before unless it occurs in the n - 1 rows after that."""
    v, i, p, q, on, off = private(df, "value", "row", "before", "after", "enters", "leaves")
    ks = list(keys) or [F.lit(0)]
    w = key_window(keys, order)
    d = df.withColumns({v: c, i: F.row_number().over(w)})
    same = Window.partitionBy(*ks, v).orderBy(i)
    d = d.withColumns({p: F.lag(i).over(same), q: F.lead(i).over(same)})
    some, row = F.col(v).isNotNull(), F.col(i)
    d = d.withColumns({on: (some & (F.col(p).isNull() | (F.col(p) <= row - n))).cast("long"), off: (some & (F.col(q).isNull() | (F.col(q) >= row + n))).cast("long")})
    by_row = Window.partitionBy(*ks).orderBy(i)
    d = d.withColumn(off, F.coalesce(F.lag(off, n).over(by_row), F.lit(0)))
    return d.withColumn(name, F.sum(F.col(on) - F.col(off)).over(by_row.rowsBetween(Window.unboundedPreceding, 0))).select(*kept(df, name))


def kept(df: DataFrame, name: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, name])]


def quantile(df: DataFrame, name: str, value: str, q: float, n: int, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    return df.withColumn(name, F.percentile(F.col(value), F.lit(q)).over(last_rows(n, keys, order)))


def autocorrelation(df: DataFrame, name: str, value: str, lag: int, n: int, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Pearson correlation, over the last n rows, of the value with that of the key's row `lag` before. Null where fewer than
    two pairs are complete or one side is constant."""
    (before,) = private(df, "before")
    d = df.withColumn(before, F.lag(value, lag).over(key_window(keys, order)))
    x, y, w = F.when(F.col(before).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(before)), last_rows(n, keys, order)
    spread = F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w))
    return d.withColumn(name, F.covar_pop(x, y).over(w) / F.nullif(spread, F.lit(0.0))).select(*kept(df, name))


def identity(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.col(value).cast("double"))


def label_feature(df: DataFrame, name: str = "label_value", label: str = "Label") -> DataFrame:
    return df.withColumn(name, F.col(label).cast("int").cast("double"))
