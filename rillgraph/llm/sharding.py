"""Sampled splitters: range sharding of records under the `bytes` law."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.functions.columns import private
from rillgraph.llm.common import cut, table

NAME = "op6_sharding"
#: Ranges that are aimed at, at most. Neighbours that fit into one are merged, so the driver and a broadcast never hold more
#: than twice as many splitters and range sums, whatever the input.
MOST_RANGES = 16_384
#: Parts a key from the order of its repeated rows; sorts before every digit.
MARK = "#"


def _range_of(key, splitters: list[str]):
    """How many splitters are <= key, by binary search in one literal array."""
    if not splitters:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    cuts = F.split(F.lit(",".join(splitters)), ",")  # folded once; keys hold no comma
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(cuts, at + step - 1) <= key, F.lit(False)), step).otherwise(0))


def _merged(stats: list, cuts: list[str], due: float) -> tuple[list, list[str]]:
    """Neighbouring ranges of at most twice the due in sum become one, so any two that are left hold more: with the due
    1 / want of the total, there are at most want + 1 of them. Empty ranges go too."""
    out: list[list] = []
    for r in stats:
        if out and out[-1][1] + r["b"] <= 2 * due:
            p = out[-1]
            p[1], p[2], p[3], p[5] = p[1] + r["b"], p[2] + r["n"], max(p[3], r["top"]), r["hi"]
        else:
            out.append([cuts[r["r"] - 1] if r["r"] else None, r["b"], r["n"], r["top"], r["lo"], r["hi"]])
    return out, [p[0] for p in out[1:]]


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 64 << 20, per_range: int = 16, seed: int = 7) -> DataFrame:
    """docs with `size` (UTF-8 bytes + 16), `shard` and `slot` (gapless from 0 in each shard); law `bytes`.

    Records are ordered by (MD5 of the text, id), so equal texts lie together and fall into one shard unless a boundary
    passes through their run. Splitters are quantiles of a sample in which a record's chance is in proportion to its size
    (Poisson, by a seeded hash: a rerun draws the same). Ranges that the exact sums then show to be over twice their due plus
    a record are subdivided by further samples, or at their last key where a sample finds nothing, until there is none: each
    round takes keys out of every such range, so it ends. If a range's one key alone is overfull, its rows (same id and text)
    are written to the shared folder with a number each, which parts them like any other keys. Exact byte sums of the ranges
    and a running sum inside each range give every record's offset; the shard is that offset's share of the total, so two
    shards differ by less than two records. No range, and so no task, is more than twice its due plus a record.

    Nulls: a null text has size 16 and sorts first, a null id sorts first among equal texts. Repeated rows (same id and
    text) are interchangeable and all kept; other columns are free. Empty input gives no rows. Columns of docs called size,
    shard or slot are replaced; all other names are free.
    """
    d = docs.drop("size", "shard", "slot")
    key, rng, sb, sn, off, nth = private(d, "key", "range", "bytes", "rows", "offset", "nth")
    d = d.withColumns({
        "size": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16,
        key: F.concat(F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")), F.lit("/"), F.regexp_replace(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "[,#]", "_")),
    })
    total, rows = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return d.drop(key).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    want = int(min(MOST_RANGES, max(4 * n_shards, -(-total // range_bytes))))
    due, heavy = total / want, set()
    base, slim = d, d.select(key, "size")

    def drawn(of: DataFrame, salt: int, of_bytes: float, n: int) -> list[str]:
        """Keys of a size-weighted sample of about n records."""
        chance = (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(1 << 52)) / float(1 << 52)) < F.col("size") * (n / of_bytes)
        return sorted({r[0] for r in of.where(chance).select(key).distinct().limit(4 * n + 1000).collect()})

    sample = drawn(slim, 0, total, want * per_range)
    cuts, salt = sorted({sample[i * len(sample) // want] for i in range(1, want)}) if sample else [], 0
    while True:
        sums = slim.withColumn(rng, _range_of(F.col(key), cuts)).groupBy(F.col(rng).alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        stats, cuts = _merged(sorted(sums.collect(), key=lambda r: r["r"]), cuts, due)  # a row for each range
        over = [(k, r) for k, r in enumerate(stats) if r[1] > 2 * due + r[3]]
        if not over:
            break
        salt += 1
        alone = {r[4] for _, r in over if r[4] == r[5]}
        several = [(k, r) for k, r in over if r[4] != r[5]]
        grown = set(cuts)
        if several:
            crowd = sum(r[1] for _, r in several)
            more = drawn(slim.where(_range_of(F.col(key), cuts).isin([k for k, _ in several])), salt, crowd, int(-(-crowd // due)) * per_range)
            for _, r in several:
                mine, parts = [x for x in more if r[4] < x <= r[5]], int(-(-r[1] // due))
                grown.update({mine[i * len(mine) // parts] for i in range(1, parts)} if len(mine) >= parts else mine or [r[5]])
        cuts = sorted(grown)
        if alone:
            heavy |= alone
            number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
            apart = cut(base.where(F.col(key).isin(sorted(heavy))).withColumn(key, F.concat(key, F.lit(MARK), number)), "repeated")
            d = base.where(~F.col(key).isin(sorted(heavy))).unionByName(apart)
            slim = d.select(key, "size")
    at, ranges = [0, 0], []
    for k, r in enumerate(stats):
        ranges.append((k, *at, r[1]))
        at = [at[0] + r[1], at[1] + r[2]]
    if at != [total, rows]:
        raise RuntimeError(f"ranges hold {at} bytes and rows of {[total, rows]}: the input changed between two reads")
    pre = docs.sparkSession.createDataFrame(ranges, f"{rng} int, {sb} long, {sn} long, _width long")
    inside = Window.partitionBy(rng).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)

    def placed(of: DataFrame, p: DataFrame) -> DataFrame:
        of = of.withColumn(rng, _range_of(F.col(key), cuts)).join(F.broadcast(p.drop("_width")), rng)  # at most 2 * MOST_RANGES rows
        of = of.withColumns({off: F.col(sb) + F.sum("size").over(inside) - F.col("size"), nth: F.col(sn) + F.row_number().over(inside) - 1})
        return of.withColumn("shard", F.expr(f"cast(`{off}` * {n_shards} div {total} as int)"))

    # A shard begins inside a range over which its boundary lies: only those ranges are ordered to find its first record.
    begins = F.expr(f"`{sb}` * {n_shards} div {total} != (`{sb}` + _width - 1) * {n_shards} div {total}")
    firsts = {r[0]: r[1] for r in placed(slim, pre.where(begins)).groupBy("shard").agg(F.min(nth)).collect()}
    for _, b, n, _w in ranges:  # ... or with the first record of a range
        s = b * n_shards // total
        firsts[s] = min(firsts.get(s, n), n)
    first = F.element_at(F.create_map(*[x for s, i in sorted(firsts.items()) for x in (F.lit(s), F.lit(i).cast("long"))]), F.col("shard"))
    return placed(d, pre).withColumn("slot", F.col(nth) - first).drop(key, rng, sb, sn, off, nth)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32; tests hold the query against brute force.
SQL = None
