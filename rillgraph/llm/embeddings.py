"""Subspace pigeonhole join of vectors by cosine."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm.common import components, cut, table, tiled

NAME = "op4_embeddings"
#: Cells are fitted on at most SAMPLE vectors of a dimension; they decide only where pairs meet, never which are links.
SAMPLE = 16_384
BLOCK_DIMS, PER_CELL, LEAST_CELLS, MOST_CELLS = 16, 8192, 4, 1024
#: Rows of a cell that one task holds (a vector each); a larger cell becomes a grid of tasks.
MOST_ROWS = 1 << 17
#: Pairs compared at once.
TILE = 1 << 22
#: Slack of block distances, far above rounding; a candidate is verified in full anyway.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norm, in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Space:
    """A seeded rotation, its blocks with their share of the squared-distance budget, and the cells of each block."""

    def __init__(self, dims: int, n: int, threshold: float, sample: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.turn = q * np.sign(np.diag(r))
        edges = np.linspace(0, dims, max(1, round(dims / BLOCK_DIMS)) + 1).round().astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        #: |x - y|^2 <= 2 - 2 t on unit vectors; some block holds at most its proportional part of it.
        self.budget = [max(0.0, 2 - 2 * threshold) * (hi - lo) / dims + SLACK for lo, hi in self.blocks]
        cells = 1
        while cells < MOST_CELLS and cells < LEAST_CELLS or cells * PER_CELL < n and cells < MOST_CELLS:
            cells *= 2
        s = sample @ self.turn
        self.pivots = []
        for lo, hi in self.blocks:
            x = s[:, lo:hi]
            p = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
            for _ in range(8):
                near = self._d2(x, p).argmin(axis=1)
                p = np.array([x[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
            self.pivots.append(np.unique(p, axis=0))
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in self.pivots])])

    @staticmethod
    def _d2(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T)

    def route(self, turned: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows, cell, home): for each block, each row's home cell (nearest pivot) and the later cells that may hold a row
        within the block's radius, that is whose bisecting hyperplane with the home is that near."""
        for b, (lo, hi) in enumerate(self.blocks):
            p, r = self.pivots[b], math.sqrt(self.budget[b])
            d2 = self._d2(turned[:, lo:hi], p)
            home = d2.argmin(axis=1)
            gap = np.sqrt(self._d2(p, p))
            far = (d2 - d2[np.arange(len(d2)), home][:, None]) / (2 * np.maximum(gap[home], 1e-300))
            for c in range(len(p)):
                rows = np.nonzero((home == c) | ((home < c) & (far[:, c] <= r + 1e-6)))[0]
                yield rows, int(self.first[b] + c), home[rows] == c

    def links(self, cell: int, units: np.ndarray, ids: np.ndarray, home: np.ndarray, point: np.ndarray, query: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (i, j) of a point and a query with cosine >= threshold that meet in this cell and in no earlier block.
        Blocks are of the rotated vectors; the cosine is that of the unit vectors themselves."""
        x = units @ self.turn
        b = int(np.searchsorted(self.first, cell, side="right")) - 1
        lo, hi = self.blocks[b]
        at, to, part = np.nonzero(point)[0], np.nonzero(query)[0], x[:, lo:hi]
        # |p - q|^2 <= budget is p.q - |p|^2 / 2 - |q|^2 / 2 + budget / 2 >= 0: one product in single precision, whose error is
        # far below the slack; what passes is measured again in double precision.
        half, one = (part * part).sum(axis=1, keepdims=True) / 2, np.ones((len(x), 1))
        left = np.concatenate([part, self.budget[b] / 2 - half, one], axis=1).astype(np.float32)[at]
        right = np.concatenate([part, one, -half], axis=1).astype(np.float32)[to].T.copy()
        rows = max(1, TILE // max(1, len(to)))
        for k in range(0, len(at), rows):
            i, j = divmod(np.flatnonzero(left[k : k + rows] @ right >= np.float32(-1e-5)), max(1, len(to)))
            i, j = at[k + i], to[j]
            keep = ~home[j] & (ids[i] != ids[j]) | (ids[i] < ids[j])
            i, j = i[keep], j[keep]
            for at2 in range(0, len(i), TILE // 64):
                u, v = i[at2 : at2 + TILE // 64], j[at2 : at2 + TILE // 64]
                dx = x[u] - x[v]
                dx *= dx
                own = [dx[:, lo2:hi2].sum(axis=1) <= self.budget[a] for a, (lo2, hi2) in enumerate(self.blocks[: b + 1])]
                ok = own[b] & ~np.logical_or.reduce([*own[:b], np.zeros(len(u), bool)])
                u, v = u[ok], v[ok]
                ok = (units[u] * units[v]).sum(axis=1) >= threshold
                yield u[ok], v[ok]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of vectors.

    Equal vectors are one class with a weight. Unit vectors are rotated and split into blocks; if two have cosine >= t, their
    squared distance is at most 2 - 2t, so in some block it is at most that block's proportional part. Each block is
    range-joined: a class is a point of the cell of its nearest pivot and a query in the later cells that its ball can reach.
    A cell compares in tiles, verifies the full cosine in double precision, and counts a pair in the first block that
    finds it. It reports each class's number of links and a spanning forest, never the pairs, so near copies cost no more
    than their number. Vectors of different length are never compared.

    A cell of more than MOST_ROWS rows is compared as a grid of points and queries, so no task grows with the input.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, link with nothing:
    n_links 0, component_id their own id. Repeated rows count as vectors of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    e = F.col("e")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
    sound = F.coalesce(F.exists(e, lambda x: x != 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.col("id").isNotNull()
    v = v.withColumn("e", F.when(sound, F.transform(e, lambda x: x.cast("double"))))
    classes = cut(v.where("e is not null").groupBy("e").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "vectors")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each dimension
    spaces, offset = {}, 0
    for d, n in sorted(sizes.items()):
        share = max(1, min(1 << 20, (SAMPLE << 20) // n))
        drawn = classes.where((F.size("e") == d) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share)).select("rep", "e").limit(2 * SAMPLE).toPandas().sort_values("rep")["e"]
        if not len(drawn):
            drawn = classes.where(F.size("e") == d).select("e").limit(1).toPandas()["e"]
        s = Space(d, n, threshold, unit(np.array(drawn.tolist(), np.float64)))
        spaces[d] = (offset, s)
        offset += int(s.first[-1])

    def send(batches: Iterator[pa.RecordBatch], vectors: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, rep, w = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            length = np.diff(col.offsets.to_numpy())
            for d in np.unique(length):
                rows = np.nonzero(length == d)[0]
                base, s = spaces[int(d)]
                flat = col.flatten().to_numpy()
                start = (col.offsets.to_numpy() - col.offsets.to_numpy()[0])[rows]
                x = unit(flat[start[:, None] + np.arange(d)])
                raw = [r.tobytes() for r in x] if vectors else None
                for at, cell, home in s.route(x @ s.turn):
                    if len(at) and not vectors:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), base + cell, np.int32)), pa.array(home)], names=["cell", "home"])
                    elif len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), base + cell, np.int32)), pa.array(rep[rows[at]]), pa.array(w[rows[at]]), pa.array(home), pa.array([raw[k] for k in at], pa.binary())], names=["cell", "rep", "w", "home", "x"])

    def search(t: pa.Table) -> pa.Table:
        cell, rep, w = t.column("cell")[0].as_py(), t.column("rep").to_numpy(), t.column("w").to_numpy()
        home, point, query_ = (t.column(c).to_numpy().astype(bool) for c in ("home", "_point", "_query"))
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(rep), -1)
        order = np.argsort(rep, kind="stable")
        rep, w, home, point, query_, x = rep[order], w[order], home[order], point[order], query_[order], x[order]
        base, s = max((o for o in spaces.values() if o[0] <= cell), key=lambda o: o[0])
        n, hub = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in s.links(cell - base, x, rep, home, point, query_, threshold):
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
            while len(i):
                a, b = hub[i], hub[j]
                far = a != b
                i, j, a, b = i[far], j[far], a[far], b[far]
                np.minimum.at(hub, np.maximum(a, b), np.minimum(a, b))
                while not (hub[hub] == hub).all():
                    hub = hub[hub]
        some = n > 0
        return pa.table({"rep": pa.array(rep[some]), "n": pa.array(n[some]), "root": pa.array(rep[hub[some]])})

    if sizes:
        sent = classes.mapInArrow(send, "cell int, rep long, w long, home boolean, x binary")
        slim = classes.mapInArrow(functools.partial(send, vectors=False), "cell int, home boolean")
        found = cut(tiled(sent, "cell", "home", MOST_ROWS, slim).groupBy("cell", "_tile").applyInArrow(search, "rep long, n long, root long"), "links")
    else:
        found = spark.createDataFrame([], "rep long, n long, root long")
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    c = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    c = c.select("e", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = v.join(c, "e", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
