"""Groups of near copies: SimHash fingerprints in vantage-point trees give candidates, MinHash bands those that lie beyond
the radius, exact Jaccard similarity of word shingles links them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import components, cut, discard, tiled
from rillgraph.llm.simhash import forest

#: Texts are near copies if the Jaccard similarity of their sets of SHINGLE words is LEAST or more.
SHINGLE, LEAST = 5, 0.8
#: Sizes of similar sets differ by a factor of 1 / LEAST at most; a shard of the SimHash search spans a STEPS-th power of it.
STEPS = 4
#: A shard of more fingerprints (32 bytes each) becomes a grid of tasks. The bound is a PARTS-th of all between these two: a grid
#: then sends each fingerprint a number of times that doesn't grow with the input.
PARTS, LEAST_ROWS, MOST_ROWS = 64, 1 << 16, 1 << 19
#: A pair at similarity s shares no band with chance (1 - s^ROWS)^BANDS: 5e-7 at 0.8, 2e-18 at 0.9.
BANDS, ROWS = 48, 6
#: A task compares at most so many texts with as many others, fewer if a text of theirs has many shingles.
TILE, TILE_SHINGLES = 1024, 1 << 22
#: Texts of small clusters that one task takes together, and keys that are broadcast at most (8 bytes each).
TOGETHER, MOST_BROADCAST = 1000, 1_000_000
_RNG = np.random.default_rng(5)
_XOR, _MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64), _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint parts them


def shingles(toks: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the runs of `shingle` words, sorted; a shorter text is one run, one without words has none."""
    if not toks:
        return np.empty(0, np.uint64)
    h64, k = xxhash.xxh64_intdigest, min(shingle, len(toks))
    found = [np.array([h64(b" ".join(s), 42) for s in zip(*(toks[at + i : at + 65_536 + i] for i in range(k)), strict=False)], np.uint64) for at in range(0, len(toks) - k + 1, 65_536)]
    return np.unique(np.concatenate(found))


def fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingles as op8 has it of a sequence: a bit is 1 if it is set in over half of the set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for texts of any length
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def second(h: np.ndarray) -> int:
    """Another fingerprint, of the shingles hashed once more: chance pairs of a large input that agree in one differ in it."""
    x = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return fingerprint((x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93))


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of minima over seeded permutations; none for an empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):  # bounded memory for texts of any length
        np.minimum(least, ((h[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _mark(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with `_row` (unique), `_node` (XXH64 of the words: equal texts are one node), `_n` shingles, `_fp`, `_second` and `_bands`."""
    d = docs.withColumn("_row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, other, size, keys = *(np.empty(b.num_rows, np.uint64) for _ in range(3)), [], []
            for i, t in enumerate(b.column(text_col)):
                toks = words(t.as_py())
                h = shingles(toks)
                node[i] = xxhash.xxh64_intdigest(b" ".join(toks), 1)
                fp[i], other[i] = fingerprint(h), second(h)
                size.append(len(h))
                keys.append(bands(h))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node.view(np.int64)), pa.array(size, pa.int64()), pa.array(fp.view(np.int64)), pa.array(other.view(np.int64)), lists], names=[*b.schema.names, "_node", "_n", "_fp", "_second", "_bands"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return cut(d.mapInArrow(run, schema + ", _node long, _n long, _fp long, _second long, _bands array<long>"), "marked")


def fingerprint_links(marked: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join the same nodes as all pairs of SimHash similarity `least` or more (12 of 64 bits differ at 0.8)
    whose sizes allow that similarity of their sets, and of which at most twice as many bits differ in the second fingerprint.

    The first vantage is the empty text, from which a text lies as far as it has shingles: shards are ranges of that distance,
    and a node is a point of its own shard and a query there and in the STEPS shards before. A ball of this radius would overlap
    nearly every shard of a tree of fingerprints. Inside a shard, or a tile of its grid, a vantage-point tree over the
    points' fingerprints is descended by all queries, and a spanning forest is reported, as in op8."""
    radius = int(64 * (1 - least))
    nodes = cut(marked.where("_n > 0").groupBy("_node").agg(F.min("_fp").alias("fp"), F.min("_second").alias("second"), F.min("_n").alias("n")), "fingerprints")
    most = max(LEAST_ROWS, min(MOST_ROWS, nodes.count() // PARTS))
    own = F.floor(F.log(F.col("n")) * (STEPS / -math.log(least))).cast("int")
    sent = nodes.select("*", own.alias("own")).withColumn("shard", F.explode(F.expr(f"sequence(own - {STEPS}, own)"))).withColumn("home", F.col("shard") == F.col("own")).drop("own")

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_node", "ascending"), ("_point", "ascending")])
        node, fp, other, n, point, query = (t.column(c).to_numpy() for c in ("_node", "fp", "second", "n", "_point", "_query"))
        fp, other = fp.view(np.uint64), other.view(np.uint64)
        fit = lambda a, b: (np.bitwise_count(other[a] ^ other[b]) <= 2 * radius) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9)
        u, v = forest(node, fp, point.astype(bool), query.astype(bool), radius, fit)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = cut(tiled(sent, "shard", "home", most).groupBy("shard", "_tile").applyInArrow(search, "u long, v long"), "near")
    discard(nodes)
    return found


def links_of(node: np.ndarray, block: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sets have a Jaccard similarity of `least` or more: of all pairs if there is one
    block, of those between two blocks otherwise. Sets are compared in order of size, so a set meets a range of the others;
    the range's sets lie in one array and are counted at once."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    node, block, size = node[order], block[order], size[order]
    flat = np.concatenate([sets[i] for i in order])
    words_, flat = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    has, root, cross = np.zeros(len(words_), np.uint8), np.arange(len(node)), block.min() != block.max()
    for i in range(len(node)):
        hi = int(np.searchsorted(size, size[i] / least + 1e-9, side="right"))  # larger sets can't be similar enough
        if hi <= i + 1 or not (root[i + 1 : hi] != root[i]).any():
            continue
        mine = flat[at[i] : at[i + 1]]
        has[mine] = 1
        both = np.add.reduceat(has[flat[at[i + 1] : at[hi]]], at[i + 1 : hi] - at[i + 1], dtype=np.int64)
        has[mine] = 0
        near = both >= (size[i] + size[i + 1 : hi] - both) * least - 1e-9
        if cross:
            near &= block[i + 1 : hi] != block[i]
        for r in np.unique(root[i + 1 : hi][near]):
            if r != root[i]:
                a, b = min(r, root[i]), max(r, root[i])
                root[root == b] = a
    joined = root != np.arange(len(node))
    return node[joined], node[root[joined]]


def _links(clusters: DataFrame, marked: DataFrame, text_col: str, least: float) -> DataFrame:
    """Links (u, v) inside clusters (node, cluster) of texts: each text's set of shingles goes once to its cluster's task, or
    to a row of tiles if the cluster is large; what comes back is a forest for each tile, never the pairs."""
    first = marked.groupBy("_node").agg(F.min("_row").alias("_row")).join(clusters.select(F.col("node").alias("_node"), "cluster"), "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(words(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "cluster", "n", "h"])

    first = cut(first.select("_row", "_node", "cluster"), "first")
    count = first.count()
    mine = F.broadcast(first) if count <= MOST_BROADCAST else first
    sets = cut(marked.select("_row", text_col).join(mine, "_row").select("_node", "cluster", text_col).mapInArrow(run, "node long, cluster long, n long, h binary"), "sets")
    tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.expr(f"{TILE_SHINGLES} div greatest(max(n), 1)")))
    large = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), tile.alias("t")).select(F.col("cluster").alias("_c"), F.ceil(F.col("m") / F.col("t")).cast("int").alias("k")).where("k > 1")
    x = sets.join(large, F.col("cluster") == F.col("_c"), "left").withColumn("k", F.coalesce("k", F.lit(1)))
    x = x.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("_o", F.explode(F.expr("sequence(0, k - 1)")))
    x = x.withColumn("tile", F.least("block", "_o").cast("long") * F.col("k") + F.greatest("block", "_o"))
    x = x.withColumn("part", F.when(F.col("k") > 1, F.xxhash64("cluster", "tile")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(1, count // TOGETHER))))).select("part", "cluster", "tile", "block", "node", "h")

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cluster", "ascending"), ("tile", "ascending"), ("node", "ascending")])
        cluster, tiles, block, node = (t.column(c).to_numpy() for c in ("cluster", "tile", "block", "node"))
        sets_ = [np.frombuffer(h.as_buffer(), np.uint64) for h in t.column("h")]
        ends = np.nonzero((cluster[1:] != cluster[:-1]) | (tiles[1:] != tiles[:-1]))[0] + 1
        u, v = [node[:0]], [node[:0]]
        for lo, hi in zip([0, *ends], [*ends, len(node)], strict=True):
            if hi - lo > 1:
                a, b = links_of(node[lo:hi], block[lo:hi], sets_[lo:hi], least)
                u.append(a)
                v.append(b)
        return pa.table({"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v))})

    found = cut(x.groupBy("part").applyInArrow(search, "u long, v long"), "links")
    discard(first, sets)
    return found


def groups(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(docs with `_row` (unique) and `_node` (of equal texts), (node, root) of the nodes that links of similarity `least` or more
    join to others). The component of a row is its node's root, or its node where it has none.

    Words are parted at ASCII white space, A-Z as lower case. Texts of equal words are one node. Nodes whose SimHash fingerprints
    of the set of shingles have a similarity of `least` or more are candidates; some similar sets lie beyond that radius, so
    nodes that share a band of minima are candidates too. Candidates that hang together are a cluster. A cluster's sets of shingles are compared in one task, or, if it
    is large (a third of all rows may be near copies), in a grid of tiles of bounded size; each tile reports a spanning
    forest. So every pair of candidates is compared or already in one component, and no pairs become rows. Similarity is
    exact on whole texts, by sets of 64-bit hashes. Texts without words are copies of each other, null texts too. Repeated
    rows stay; empty input gives no rows. docs may have no column `_row`, `_node`, `_n`, `_fp`, `_second` or `_bands` (ValueError).
    """
    if {c.lower() for c in docs.columns} & {"_row", "_node", "_n", "_fp", "_second", "_bands"}:
        raise ValueError("a column has a name that is made here")
    marked = _mark(docs, text_col)
    keyed = marked.select(F.explode("_bands").alias("key"), F.col("_node").alias("node"))
    many = cut(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("key", "a"), "many")
    n = many.count()
    out = marked.drop("_n", "_fp", "_second", "_bands")
    meet = keyed.join(F.broadcast(many) if n <= MOST_BROADCAST else many, "key").select(F.col("node").alias("u"), F.col("a").alias("v")).where("u != v").distinct()
    near = fingerprint_links(marked, least)
    clusters = cut(components(meet.union(near)).select("node", F.col("root").alias("cluster")), "clusters")
    discard(many, near)
    if clusters.isEmpty():
        return out, clusters.select("node", F.col("cluster").alias("root"))
    return out, cut(components(_links(clusters, marked, text_col, least)), "roots")
