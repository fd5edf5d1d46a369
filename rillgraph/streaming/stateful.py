"""Streaming twins: count windows by keyed state, patterns by stream-stream joins."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillgraph.functions.columns import private
from rillgraph.operators.histogram import held, shape
from rillgraph.operators.sequential import RotatingDistinct, median
from rillgraph.operators.topk import dormant


class Live:
    """A feature of one key while a batch of its rows passes: add() takes a value and gives the feature. saved() is its state
    between batches, a JSON value of bounded size that is read and written once for each batch, not for each row."""

    def add(self, v: float) -> float | None:
        raise NotImplementedError

    def saved(self) -> object:
        raise NotImplementedError


#: A step makes a Live from the state that was saved, or from None.
Step = Callable[[object], Live]


class LastN(Live):
    """fn of the last n values; at most 2n are held, so that a row moves one value on average."""

    def __init__(self, n: int, fn: Callable[[list], float], state):
        self.n, self.fn, self.ring = n, fn, list(state or [])

    def add(self, v):
        self.ring.append(v)
        if len(self.ring) >= 2 * self.n:
            del self.ring[: -self.n]
        return self.fn(self.ring[-self.n :])

    def saved(self):
        return self.ring[-self.n :]


def last_n(n: int, fn: Callable[[list], float]) -> Step:
    return lambda state: LastN(n, fn, state)


class Histogram(LastN):
    """sum, ave or var over the exponential histogram's window."""

    def __init__(self, n: int, k: int, op: str, state):
        self.rows, ring = state or (0, [])
        super().__init__(shape(n, k)[1], lambda x: self.of(x[-held(self.rows, n, k) :], op), ring)

    @staticmethod
    def of(x: list, op: str) -> float:
        mean = sum(x) / len(x)
        return {"sum": lambda: sum(x), "ave": lambda: mean, "var": lambda: sum((y - mean) ** 2 for y in x) / len(x)}[op]()

    def add(self, v):
        self.rows += 1
        return super().add(v)

    def saved(self):
        return [self.rows, super().saved()]


def histogram_step(n: int, k: int, op: str) -> Step:
    return lambda state: Histogram(n, k, op, state)


class TopK(Live):
    """Highest frequency of the block top-k; None until a block is frozen. The frozen blocks are counted when one is added."""

    def __init__(self, n: int, b: int, k: int, state):
        self.b, self.k, self.keep = b, k, dormant(n, b)
        done, self.block = state or ([], [])
        self.done = [[tuple(x) for x in blk] for blk in done]
        self.count()

    def count(self):
        total: Counter = Counter()
        for blk in self.done:
            total.update({str(x): c for x, c in blk})
        self.top = max(total.values()) / (len(self.done) * self.b) if total else None

    def add(self, v):
        if len(self.block) == self.b:
            top = sorted(Counter(self.block).items(), key=lambda x: (-x[1], str(x[0])))[: self.k]
            self.done, self.block = [*self.done, top][-self.keep :], []
            self.count()
        self.block.append(v)
        return self.top

    def saved(self):
        return [self.done, self.block]


def topk_step(n: int, b: int, k: int) -> Step:
    return lambda state: TopK(n, b, k, state)


class Distinct(Live):
    """The rotating count of distinct values."""

    def __init__(self, n: int, state):
        self.of = RotatingDistinct(n)
        if state:
            self.of.sets, self.of.at, self.of.rows = [set(s) for s in state[0]], state[1], state[2]

    def add(self, v):
        return float(self.of.add(v))

    def saved(self):
        return [[sorted(s) for s in self.of.sets], self.of.at, self.of.rows]


def distinct_step(n: int) -> Step:
    return lambda state: Distinct(n, state)


class Change(Live):
    """The value less the one before."""

    def __init__(self, state):
        self.last = state

    def add(self, v):
        out = None if self.last is None else v - self.last
        self.last = v
        return out

    def saved(self):
        return self.last


STEPS: dict[str, Callable[..., Step]] = {
    "sum": lambda n: last_n(n, math.fsum), "ave": lambda n: last_n(n, lambda x: math.fsum(x) / len(x)), "max": lambda n: last_n(n, max), "min": lambda n: last_n(n, min), "median": lambda n: last_n(n, lambda x: median(sorted(x))),
    "prev": lambda: Change,
}


def windowed(stream: DataFrame, keys: Sequence[str], value: str, steps: dict[str, Step], time: str = "ts", edge_id: str = "edge_id", late: str = "10 minutes", forget: float | None = None) -> DataFrame:
    """(keys..., edge_id, ts, features...) for each row of a stream, in (ts, edge_id) order inside each micro-batch.

    Rows later than the watermark are dropped; a row that arrives in a later batch than its successors is applied when it
    arrives. State is one JSON string for each key in the state store (RocksDB where configured). With `forget`, a key whose
    last row lies more than so many seconds before the watermark is evicted and begins anew; else keys are held for ever.
    """
    fields = [stream.schema[c] for c in [*keys, edge_id, time]]
    out = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in steps]])

    def run(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        live = {n: f(old.get(n)) for n, f in steps.items()}
        rows = pd.concat(list(pdfs)).sort_values([time, edge_id], kind="stable")
        values = rows[value].tolist()
        made = {n: [x.add(v) for v in values] for n, x in live.items()}
        last = max(last, int(rows[time].max().timestamp() * 1000))
        state.update((json.dumps({n: x.saved() for n, x in live.items()}), last))
        if forget is not None:
            state.setTimeoutTimestamp(max(last + int(forget * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[[*keys, edge_id, time]].assign(**{n: pd.Series(x, index=rows.index, dtype="float64") for n, x in made.items()})

    s = stream.withWatermark(time, late)
    kept = T.StructType([T.StructField("state", T.StringType()), T.StructField("last", T.LongType())])
    return s.groupBy(*keys).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout)


#: Buckets of a stream join, in windows: an edge on the left is held once more if its window ends in the next bucket.
STRIDE = 4


def follow(left: DataFrame, right: DataFrame, key_left: str, key_right: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """Stream-stream join of edges: right starts after left, at the same vertex, within so many seconds. The watermarks
    let Spark drop state that can no longer match.

    Spark's join compares a row with all that is held under its equi key. Times are therefore cut into buckets, which join
    the vertex in the key: an edge meets those of nearby times at its vertex, however many the vertex has in all."""
    a = left.withWatermark("ts", late).select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.withWatermark("ts", late).select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    reach = F.expr(f"INTERVAL {seconds} SECONDS")
    bucket = lambda t: F.floor(F.unix_micros(t) / max(1, round(STRIDE * seconds * 1e6)))
    (near,) = private(a, "bucket")
    (at,) = private(b, f"{near}_of")
    a = a.withColumn(near, F.explode(F.sequence(bucket(F.col("a_ts")), bucket(F.col("a_ts") + reach))))
    b = b.withColumn(at, bucket(F.col("b_ts")))
    on = (F.col(f"a_{key_left}") == F.col(f"b_{key_right}")) & (F.col(near) == F.col(at)) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + reach)
    return a.join(b, on).drop(near, at)


def distinct_within(stream: DataFrame, keys: Sequence[str], ttl: str, time: str = "ts") -> DataFrame:
    """First sighting of each key; it is forgotten ttl after."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(list(keys))


def shed(stream: DataFrame, keep: float, seed: int = 1) -> DataFrame:
    """Load shedding: a seeded share of the rows (a feature to be chosen, off by default)."""
    return stream.sample(keep, seed)
