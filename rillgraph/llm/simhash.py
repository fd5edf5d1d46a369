"""Vantage-point trees over SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm.common import components, cut, table, tiled

NAME = "op8_simhash"
#: The routing tree is fitted on at most this many fingerprints; it decides only where work is done, never the result.
SAMPLE = 65_536
#: Fingerprints that a shard is to hold; shards are a power of two between these bounds.
PER_SHARD, LEAST_SHARDS, MOST_SHARDS = 16_384, 64, 4096
#: Rows of a shard that one task holds (about 20 bytes each); a larger shard becomes a grid of tasks.
MOST_ROWS = 1 << 20
#: Below this many comparisons a branch is compared outright, in blocks of at most as many.
DENSE = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: bit i is 1 if it is set in over half the XXH64 (seed 42) of the shingles, repeats included; 0 without words."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, parted at \x20 \x09-\x0D only
    if not toks:
        return 0
    if len(toks) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(toks), 42)
    h64, n, ones = xxhash.xxh64_intdigest, len(toks) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for texts of any length
        part = toks[at : at + 65_536 + shingle - 1]
        h = np.array([h64(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(shingle)), strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _dist(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few points the one whose distances spread most, and the radius that halves the points best."""
    best = None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        d = _dist(points, v)
        r = int(np.median(d))
        # the share of points that a query ball would send to both sides is what costs
        r = min(range(r - 2, r + 3), key=lambda x: abs((d <= x).mean() - 0.5))
        cost = (np.abs(d - r - 0.5) <= 3.5).mean() + 2 * abs((d <= r).mean() - 0.5)
        if best is None or cost < best[0]:
            best = (cost, v, r)
    return best[1], best[2]


def fit_tree(sample: np.ndarray, depth: int, seed: int = 1) -> list[tuple[int, int] | None]:
    """A vantage-point tree as a heap of 2^depth - 1 (vantage, radius); None where the sample can't be parted."""
    rng, nodes, sets = np.random.default_rng(seed), [None] * ((1 << depth) - 1), {0: sample}
    for k in range(len(nodes)):
        s = sets.pop(k, np.empty(0, np.uint64))
        left = s
        if len(s) >= 2:
            v, r = _vantage(s, rng)
            inner = _dist(s, v) <= r
            if inner.any() and not inner.all():
                nodes[k], left = (int(v), r), s[inner]
                sets[2 * k + 2] = s[~inner]
        sets[2 * k + 1] = left
    return nodes


def route(fp: np.ndarray, nodes: list, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): each fingerprint's own shard, and every other that its ball of that radius overlaps."""
    row, at, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    for _ in range(depth):
        has = np.array([nodes[k] is not None for k in range(len(nodes))])[at]
        v = np.array([n[0] if n else 0 for n in nodes], np.uint64)[at]
        r = np.array([n[1] if n else 64 for n in nodes], np.int16)[at]
        d = np.bitwise_count(fp[row] ^ v).astype(np.int16)
        own_left = ~has | (d <= r)
        left = ~has | (d <= r + radius)  # triangle bound: a neighbour within the radius may lie inside
        right = has & (d > r - radius)
        row, at, home = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2]), np.concatenate([(home & own_left)[left], (home & ~own_left)[right]])
    return row, at - ((1 << depth) - 1), home


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of indices (i, j) with points[i] and queries[j] within the radius: descends a vantage-point tree of the points
    with all queries at once, and prunes the queries of each branch by the triangle bound."""
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > 32 and len(p) * len(q) > DENSE // 16:
            v, r = _vantage(points[p] if len(p) <= 4096 else points[rng.choice(p, 4096, replace=False)], rng)
            dp, dq = _dist(points[p], v), _dist(queries[q], v)
            inner = dp <= r
            if 0.02 < inner.mean() < 0.98:
                stack += [(p[inner], q[dq <= r + radius]), (p[~inner], q[dq > r - radius])]
                continue
        rows = max(1, DENSE // len(q))
        for at in range(0, len(p), rows):
            i, j = np.nonzero(np.bitwise_count(points[p[at : at + rows], None] ^ queries[None, q]) <= radius)
            yield p[at + i], q[j]


def forest(ids: np.ndarray, fp: np.ndarray, point: np.ndarray, query: np.ndarray, radius: int, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as all links between points and queries would: one for each joined row at most. Pairs of
    rows within the radius are links if `also` holds for them."""
    hub = np.arange(len(ids))
    at, to = np.nonzero(point)[0], np.nonzero(query)[0]
    for i, j in near_pairs(fp[at], fp[to], radius):
        a, b = at[i], to[j]
        if also is not None:
            good = also(a, b)
            a, b = a[good], b[good]
        while len(a):  # hook larger hubs to smaller ones until this block's links are settled
            ra, rb = hub[a], hub[b]
            far = ra != rb
            a, b, ra, rb = a[far], b[far], ra[far], rb[far]
            np.minimum.at(hub, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = hub[hub]
                if (up == hub).all():
                    break
                hub = up
    joined = hub != np.arange(len(ids))
    return ids[joined], ids[hub[joined]]


def simhash_components(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component): fp as 16 lowercase hex digits, component the smallest id reachable by links of at most `radius` bits.

    Equal fingerprints are one class, searched once. A tree of vantage points, fitted on a bounded sample, parts the classes
    into shards; a class is a point of its own shard and a query in each shard that its ball overlaps and that comes after
    its own (each pair meets at least once). Inside a shard, a vantage-point tree over its points is descended by all queries
    together; pairs are exact. A shard reports a spanning forest of the links it found, so a group of n near copies costs
    n - 1 links, not n^2; components are then joined across shards in the DataFrame engine.

    A shard of more than MOST_ROWS rows is compared as a grid of points and queries, so no task grows with the input.

    Null or wordless texts have fingerprint 0 and link like any other. Null ids get the component of their class; a class
    whose ids are all null takes no part in linking (it has no id to name or join) and its component is null. Repeated rows
    stay. Texts of any length are read whole, in bounded pieces. Empty input gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")
    n = classes.count()
    shards = LEAST_SHARDS
    while shards < MOST_SHARDS and shards * PER_SHARD < n:
        shards *= 2
    depth = shards.bit_length() - 1
    drawn = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) * 9 // (10 * max(1, n))))).select("fp").limit(SAMPLE).toPandas()["fp"]
    tree = fit_tree(np.sort(drawn.to_numpy(np.int64)).view(np.uint64), depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            row, shard, home = route(fp, tree, depth, radius)
            own = np.empty(len(fp), np.int64)
            own[row[home]] = shard[home]
            keep = home | (shard > own[row])
            row, shard, home = row[keep], shard[keep], home[keep]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fp[row].view(np.int64)), pa.array(rep[row]), pa.array(home)], names=["shard", "fp", "rep", "home"])

    def search(t: pa.Table) -> pa.Table:
        fp, rep, point, query_ = (t.column(c).to_numpy() for c in ("fp", "rep", "_point", "_query"))
        order = np.lexsort((fp, rep))
        u, v = forest(rep[order], fp[order].view(np.uint64), point[order].astype(bool), query_[order].astype(bool), radius)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    sent = cut(classes.mapInArrow(send, "shard int, fp long, rep long, home boolean"), "sent")
    links = tiled(sent, "shard", "home", MOST_ROWS).groupBy("shard", "_tile").applyInArrow(search, "u long, v long")
    roots = components(links)
    found = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return fps.join(found, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")
