"""Temporal patterns: edges with shared variables, time ranges and vertex constraints, as a chain of equi-joins."""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[float | None, float | None]


@dataclass
class Edge:
    src: str
    name: str
    trg: str
    start: Range = (None, None)
    end: Range = (None, None)
    where: Column | None = None


@dataclass
class Pattern:
    """A query over edges (edge_id, src, dst, t, dur). Bounds are relative to the query's zero and inclusive."""

    max_offset: float = 100.0
    edges: list[Edge] = field(default_factory=list)
    constraints: list[tuple[str, bool, object]] = field(default_factory=list)
    constants: dict[str, object] = field(default_factory=dict)

    def edge(self, src: str, name: str, trg: str, where: Column | None = None) -> Pattern:
        if any(e.name == name for e in self.edges):
            raise ValueError(f"two edges are named {name}")
        self.edges.append(Edge(src, name, trg, where=where))
        return self

    def time(self, which: str, name: str, op: str, value: float) -> Pattern:
        """which: 'start' or 'end' of the edge; op: =, <, <=, > or >=."""
        e = next((e for e in self.edges if e.name == name), None)
        if e is None or which not in ("start", "end"):
            raise ValueError(f"no such edge or time: {which}({name})")
        lo, hi = getattr(e, which)
        if op in ("=", "==", ">", ">="):
            lo = value
        if op in ("=", "==", "<", "<="):
            hi = value
        setattr(e, which, (lo, hi))
        return self

    def vertex(self, variable: str, inside: bool, what: str | DataFrame) -> Pattern:
        """what: an array column of the edges (values as of the edge's row; null fails both ways), or a one-column table."""
        self.constraints.append((variable, inside, what))
        return self

    def constant(self, variable: str, value: object) -> Pattern:
        """The variable binds this vertex only."""
        if self.constants.setdefault(variable, value) != value:
            raise ValueError(f"{variable} can't be two vertices")
        return self

    def finalize(self) -> list[Edge]:
        """Edges in time order with complete ranges; raises if an edge has no time, no zero exists, or edges don't connect."""
        off, done = self.max_offset, []
        for e in self.edges:
            (s0, s1), (e0, e1) = e.start, e.end
            if s0 is None and s1 is None and e0 is None and e1 is None:
                raise ValueError(f"edge {e.name} has no time")
            fill = lambda lo, hi: (hi - off if lo is None and hi is not None else lo, lo + off if hi is None and lo is not None else hi)
            (s0, s1), (e0, e1) = fill(s0, s1), fill(e0, e1)
            if s0 is None:
                s0, s1 = e0 - off, e1
            if e0 is None:
                e0, e1 = s0, s1 + off
            done.append(Edge(e.src, e.name, e.trg, (s0, s1), (e0, e1), e.where))
        if not done:
            raise ValueError("a pattern needs an edge")
        done.sort(key=lambda e: e.start[0])
        if done[0].start[0] != 0 and done[0].end[1] != 0:
            raise ValueError("neither the first edge's start nor its end is the zero")
        bound: set[str] = set()
        for e in done:
            if bound and not bound & {e.src, e.trg}:
                raise ValueError(f"edge {e.name} shares no vertex with those before it")
            bound |= {e.src, e.trg}
        return done

    def extent(self) -> float:
        return max(max(e.start[1], e.end[1]) for e in self.finalize())


def match(edges: DataFrame, pattern: Pattern, bucket: bool = True) -> DataFrame:
    """Every combination of edges that the pattern describes: a struct (edge_id, src, dst, t, dur) for each edge, and a
    column for each variable.

    Each edge is one equi-join on its bound vertices (rule: it starts strictly after the edge before it), with the time
    range as a residual; with `bucket`, times are cut into buckets of the range's width and the bucket is an equi key too, so
    a hub vertex meets only edges of nearby times. Variables may bind the same vertex. Catalyst chooses the joins.
    """
    order = pattern.finalize()
    arrays = [(v, inside, w) for v, inside, w in pattern.constraints if isinstance(w, str)]
    acc, bound, before = None, [], None
    for i, e in enumerate(order):
        c = edges
        if e.where is not None:
            c = c.where(e.where)
        if e.src == e.trg:
            c = c.where("src = dst")
        for end, v in (("src", e.src), ("dst", e.trg)):
            if v in pattern.constants:  # reaches the scan
                c = c.where(F.col(end) == F.lit(pattern.constants[v]))
        for v, inside, w in arrays:
            for end in [x for x, var in (("src", e.src), ("dst", e.trg)) if var == v]:
                has = F.array_contains(F.col(w), F.col(end).cast("string"))
                c = c.where(has if inside else ~has)
        c = c.select(F.struct("edge_id", "src", "dst", F.col("t").cast("double").alias("t"), F.col("dur").cast("double").alias("dur")).alias(e.name))
        t, stop = F.col(f"{e.name}.t"), F.col(f"{e.name}.t") + F.col(f"{e.name}.dur")
        (s0, s1), (e0, e1) = e.start, e.end
        if i == 0:
            zero = t if s0 == 0 else stop
            acc = c.withColumn("_zero", zero)
            acc = acc.where(t.between(F.col("_zero") + s0, F.col("_zero") + s1) & stop.between(F.col("_zero") + e0, F.col("_zero") + e1))
            acc = acc.withColumns({v: F.col(f"{e.name}.{end}") for end, v in (("src", e.src), ("dst", e.trg))})
            bound = list(dict.fromkeys([e.src, e.trg]))
        else:
            on = (t > F.col(f"{before}.t")) & t.between(F.col("_zero") + s0, F.col("_zero") + s1) & stop.between(F.col("_zero") + e0, F.col("_zero") + e1)
            for end, v in (("src", e.src), ("dst", e.trg)):
                if v in bound:
                    on = (F.col(v) == F.col(f"{e.name}.{end}")) & on
            width = s1 - s0
            if bucket and width > 0:
                acc = acc.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_zero") + s0) / width), F.floor((F.col("_zero") + s1) / width))))
                c = c.withColumn("_at", F.floor(t / width))
                on = (F.col("_bucket") == F.col("_at")) & on
            acc = acc.join(c, on).drop("_bucket", "_at")
            new = {v: F.col(f"{e.name}.{end}") for end, v in (("src", e.src), ("dst", e.trg)) if v not in bound}
            acc, bound = acc.withColumns(new) if new else acc, [*bound, *new]
        before = e.name
    for k, (v, inside, w) in enumerate(x for x in pattern.constraints if not isinstance(x[2], str)):
        keys = w.select(F.col(w.columns[0]).alias(f"_set{k}")).distinct()
        acc = acc.join(keys, F.col(v) == F.col(f"_set{k}"), "left_semi" if inside else "left_anti")
    return acc.drop("_zero")


#: The longest time that triangle() leaves between the first start and an end.
LONGEST = 1e12


def triangle(window: float) -> Pattern:
    """x -> y -> z -> x with rising starts, all within `window` of the first."""
    p = Pattern(max_offset=window).edge("x", "e1", "y").edge("y", "e2", "z").edge("z", "e3", "x").time("start", "e1", "=", 0)
    for e in ("e2", "e3"):
        p.time("start", e, ">=", 0).time("start", e, "<=", window)
    for e in ("e1", "e2", "e3"):
        p.time("end", e, ">=", 0).time("end", e, "<=", LONGEST)
    return p


#: Edges of one cell of a bucket of time, about; a bucket with more becomes a grid of cells over two of the triangle's vertices.
CELL = 1 << 20
#: Buckets of time, at most, and their least width in windows.
BUCKETS, STRIDE = 4096, 4


def count_triangles(edges: DataFrame, window: float) -> DataFrame:
    """The number of rows that match(edges, triangle(window)) has, counted without making them or their pairs.

    Edges are dealt by buckets of time, with the window after each, so the shuffle is at most 1.25 times the edges. A bucket's
    triangles are counted for each x, y, z from running counts of its sorted edges. Edges that end before they start, or
    so late that the ends may decide, are matched."""
    if window <= 0:
        return match(edges, triangle(window)).agg(F.count(F.lit(1)).alias("triangles"))
    plain = F.col("dur").cast("double").between(0.0, 0.9 * LONGEST - window)
    parts = [_counted(edges.where(plain), window)]
    for k in range(3):  # the first odd edge is the kth
        p = triangle(window)
        for e, where in zip(p.edges, [plain] * k + [~plain], strict=False):
            e.where = where
        parts.append(match(edges, p).agg(F.count(F.lit(1)).alias("triangles")))
    return reduce(DataFrame.unionByName, parts).agg(F.sum("triangles").alias("triangles"))


def _counted(edges: DataFrame, window: float) -> DataFrame:
    d = edges.select("src", "dst", F.col("t").cast("double").alias("t")).where("src is not null and dst is not null and abs(t) < double('infinity')")
    first, last = d.agg(F.min("t"), F.max("t")).first()
    first, width = first or 0.0, max(STRIDE * window, ((last or 0.0) - (first or 0.0)) / BUCKETS)
    bucket = lambda t: F.floor((t - first) / width)
    t, own = F.col("t"), bucket(F.col("t"))
    reach = 1.01 * window + F.abs(t) * 1e-14  # more than the window, whatever is rounded
    full = d.groupBy(own.alias("full")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("full", F.ceil(F.col("n") / CELL).alias("g"))
    d = d.withColumns({"home": own, "at": F.explode(F.sequence(F.greatest(bucket(t - reach), F.lit(0)), own))})
    d = d.join(F.broadcast(full), F.col("at") == F.col("full"), "left").drop("full")
    g = F.col("g")
    h = lambda c: F.pmod(F.xxhash64(c), g)
    cell = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    line = F.sequence(F.lit(0), g - 1)
    grid = F.concat(F.array(cell(h("src"), h("dst"), 1)), F.transform(line, lambda i: cell(i, h("src"), 2)), F.transform(line, lambda i: cell(h("dst"), i, 4)))
    zero = F.lit(0).cast("long")
    d = d.withColumn("cell", F.explode(F.when(g.isNull(), F.array(cell(zero, zero, 7))).otherwise(grid)))
    d = d.select("at", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "src", "dst", "t", F.when(F.col("home") == F.col("at"), F.col("cell.role")).otherwise(F.col("cell.role").bitwiseAND(6)).alias("role"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, _ = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        return pd.DataFrame({"triangles": [_count_cell(codes[: len(pdf)], codes[len(pdf) :], pdf["t"].to_numpy(), pdf["role"].to_numpy(), window)]})

    return d.groupBy("at", "x", "y").applyInPandas(run, "triangles long").agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))


def _count_cell(src: np.ndarray, dst: np.ndarray, t: np.ndarray, role: np.ndarray, window: float) -> int:
    """Triangles x -> y -> z -> x. For each last edge: over the first edges that are open at its time, the middle edges before it
    less those up to the first edge, by running sums."""

    def by_pair(bit: int) -> dict:
        """(src, dst) -> sorted times, of the edges of a role."""
        rows = np.flatnonzero(role & bit)
        rows = rows[np.lexsort((t[rows], dst[rows], src[rows]))]
        s, d, at = src[rows], dst[rows], t[rows]
        cut = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(rows)]
        return {(int(s[i]), int(d[i])): at[i:j] for i, j in itertools.pairwise(cut) if j > i}

    a, b, c = (by_pair(bit) for bit in (1, 2, 4))
    out, back = defaultdict(set), defaultdict(set)
    for y, z in b:
        out[y].add(z)
    for z, x in c:
        back[x].add(z)
    total = 0
    for (x, y), ta in a.items():
        closes = ta + window
        for z in out[y] & back[x]:
            tb, tc = b[y, z], c[z, x]
            gone, begun = np.searchsorted(closes, tc, "left"), np.searchsorted(ta, tc, "left")
            upto = np.concatenate(([0], np.cumsum(np.searchsorted(tb, ta, "right"))))
            total += int(((begun - gone) * np.searchsorted(tb, tc, "left") - (upto[begun] - upto[gone])).sum())
    return total
