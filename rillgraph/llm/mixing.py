"""Hierarchical budgeting: mix sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.functions.columns import private
from rillgraph.llm.common import cut, discard, table

NAME = "op2_mixing"
LEVELS = ("domain", "lang", "source")
#: Words are parted at ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Target weights by level and value; a value that is not named has DEFAULT.
WEIGHTS = {"domain": {"dom0": 0.4, "dom1": 0.3, "dom2": 0.2, "dom3": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "source": {}}
FRACTION, EPOCHS, SEED = 0.6, 2, 42
#: Leaves are broadcast up to this many (about 200 bytes each), and shuffled beyond; AQE then splits a hot leaf.
MOST_BROADCAST = 100_000
#: The rows among which a leaf's budget ends are narrowed down by two hex digits at a time until there are at most so many.
FEW, DIGITS = 1024, 48
#: The tables name no domain: it is the source's number modulo 4.
DOMAIN = "concat('dom', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as string), 'x'))"


def _weight(level: str, weights: dict):
    """A value that is not named (null is one) has the smallest weight named in its level, or 1 where none is."""
    named = weights.get(level, {})
    out = F.lit(float(min(named.values(), default=1.0)))
    for value, w in named.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def _same(levels, prefix: str) -> list:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{j}")) for j, k in enumerate(levels)]


def budgets(leaves: DataFrame, weights: dict, fraction: float, epochs: int, levels=LEVELS) -> DataFrame:
    """leaves (levels..., avail) with `budget`, whole tokens: fraction of all available tokens, shared out down the tree.

    Each node shares its budget among its children in proportion to their weights; no child gets more than its subtree can
    give in `epochs` epochs, and what it can't take goes to its siblings first (water-filling: with children ordered by
    capacity / weight, the smallest water level that spends the budget). A parent is never given more than its children can
    take, so a shortage leaves a subtree only when all siblings in it are full. Children of weight 0 get nothing. The frames
    hold a row for each node; columns whose names start with `_` are of its own making.
    """
    caps = leaves.withColumn("_cap", F.col("avail") * epochs)
    top = caps.agg(F.floor(F.coalesce(F.sum("avail"), F.lit(0)) * F.lit(float(fraction))).cast("double").alias("_b"))
    parent, above = top.withColumn("_root", F.lit(1)), ["_root"]
    for i, level in enumerate(levels):
        keys = ["_root", *levels[: i + 1]]
        kids = caps.withColumn("_root", F.lit(1)).groupBy(*keys).agg(F.sum("_cap").cast("double").alias("_c")).withColumn("_w", _weight(level, weights)).where("_w > 0")
        p = parent.select(*[F.col(k).alias(f"_p{j}") for j, k in enumerate(above)], "_b")
        kids = kids.join(p, _same(above, "_p")).drop(*[f"_p{j}" for j in range(len(above))])
        order = Window.partitionBy(*above).orderBy(F.col("_c") / F.col("_w"), *[F.col(k) for k in keys])
        upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        # The level if this child and all larger ones are not full; children before it give all they can.
        kids = kids.withColumn("_l", (F.col("_b") - F.coalesce(F.sum("_c").over(upto), F.lit(0.0))) / F.sum("_w").over(after))
        full = F.col("_c") / F.col("_w") <= F.col("_l")
        kids = kids.withColumn("_level", F.max(F.when(~full, F.col("_l"))).over(Window.partitionBy(*above)))
        parent = kids.select(*keys, F.when(F.col("_level").isNull() | (F.col("_c") <= F.col("_level") * F.col("_w")), F.col("_c")).otherwise(F.col("_level") * F.col("_w")).alias("_b"))
        above = keys
    b = parent.select(*[F.col(k).alias(f"_p{j}") for j, k in enumerate(levels)], F.floor(F.col("_b") + 1e-6).cast("long").alias("budget"))
    return leaves.join(b, _same(levels, "_p"), "left").drop(*[f"_p{j}" for j in range(len(levels))]).fillna(0, ["budget"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _key(seed: int, epoch, id_, text_hash):
    """48 hex digits: the place of a document in a seeded epoch; only rows of the same id and text share it."""
    return F.concat(F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), id_).cast("binary")), F.lpad(F.lower(F.hex(text_hash)), 16, "0"))


def _stops(slim: DataFrame, leaves: DataFrame, n_leaves: int, seed: int) -> DataFrame:
    """(levels..., stop): the first key of each leaf's begun epoch that its budget doesn't reach.

    Running sums over 256 parts of a leaf find the part in which the budget ends, and so on inside that part, two digits of the
    key at a time; only the last part, of at most FEW rows, is ordered by whole keys. So no leaf is gathered, however large.
    """
    at = leaves.where("_rest > 0").select(*LEVELS, F.col("_full"), F.col("_rest"), F.lit("").alias("_p"), F.lit(0).cast("long").alias("_before"), F.col("_n"))
    digits = 0
    while True:
        near = at.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(LEVELS)], "_full", "_rest", "_p", "_before")
        inside = slim.join(_small(near, n_leaves), _same(LEVELS, "_j")).withColumn("_k", _key(seed, F.col("_full") + 1, F.col("_i"), F.col("_h"))).where(F.col("_k").startswith(F.col("_p")))
        if digits >= DIGITS or (at.agg(F.max("_n")).first()[0] or 0) <= FEW:
            break
        sums = inside.groupBy(*LEVELS, "_full", "_rest", "_p", "_before", F.substring("_k", digits + 1, 2).alias("_d")).agg(F.sum("_t").alias("_s"), F.count(F.lit(1)).alias("_n"))
        run = F.col("_before") + F.sum("_s").over(Window.partitionBy(*LEVELS).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("_run", run).where("_run - _s <= _rest and _run > _rest")
        old, at = at, cut(sums.select(*LEVELS, "_full", "_rest", F.concat("_p", "_d").alias("_p"), (F.col("_run") - F.col("_s")).alias("_before"), "_n"), "ends")
        discard(old)
        digits += 2
    sums = inside.groupBy(*LEVELS, "_rest", "_before", "_k").agg(F.sum("_t").alias("_s"))
    run = F.col("_before") + F.sum("_s").over(Window.partitionBy(*LEVELS).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("_run", run).where("_run > _rest").groupBy(*LEVELS).agg(F.min("_k").alias("_stop"))


def mix(docs: DataFrame, weights: dict = WEIGHTS, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `domain`, `n_tokens` (words), `budget` (of the leaf) and `epoch`: the rows that the mixture takes.

    A leaf is a (domain, lang, source); nulls are values of their own. Its epochs 1, 2, ... are its documents in the order
    of MD5(seed / epoch / id), and it gets the longest prefix of whole documents of that endless list whose words stay
    within its budget (documents without words come with the prefix; an epoch is begun only if budget is left for it). A
    document is repeated only in a later epoch. Of one id documents are ordered by a hash of the text; rows that share both
    are taken together or not at all.

    The texts are scanned twice: once for a written table of ids, leaves and words, from which budgets and the key at which
    each leaf stops are found, and once to take the documents whose keys come before it. Documents meet the leaves' rows in a
    broadcast join (beyond MOST_BROADCAST leaves in a shuffled one); none is shuffled or sorted.

    Null texts have no words. Empty input or a zero budget gives no rows. Columns of docs called domain, n_tokens, budget or
    epoch are replaced; `lang` and `source` are needed; all other names are free.
    """
    lv = private(docs.drop("domain", "n_tokens", "budget", "epoch"), *LEVELS, "full", "rest", "stop", "budget")
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    d = docs.drop("domain", "n_tokens", "budget", "epoch").withColumns({"domain": F.expr(domain), "n_tokens": n_tokens})
    id_, text_hash = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.col(text_col))
    slim = cut(d.select(*LEVELS, id_.alias("_i"), text_hash.alias("_h"), F.col("n_tokens").alias("_t")), "leaf-rows")
    leaves = budgets(slim.groupBy(*LEVELS).agg(F.sum("_t").alias("avail"), F.count(F.lit(1)).alias("_n")), weights, fraction, epochs)
    leaves = leaves.withColumn("_full", F.least(F.lit(epochs), F.when(F.col("avail") > 0, F.expr("budget div avail")).otherwise(0)).cast("int"))
    leaves = cut(leaves.withColumn("_rest", F.when(F.col("_full") < epochs, F.col("budget") - F.col("_full") * F.col("avail")).otherwise(0)).select(*LEVELS, "budget", "_full", "_rest", "_n"), "leaves")
    n_leaves = leaves.count()
    stops = cut(_stops(slim, leaves, n_leaves, seed), "stops")
    discard(slim)
    s = stops.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(LEVELS)], "_stop")
    ends = leaves.where("_full > 0 or _rest > 0").join(s, _same(LEVELS, "_s"), "left")
    ends = ends.select(*[F.col(k).alias(lv[i]) for i, k in enumerate(LEVELS)], F.col("_full").alias(lv[3]), F.col("_rest").alias(lv[4]), F.col("_stop").alias(lv[5]), F.col("budget").alias(lv[6]))
    d = d.join(_small(ends, n_leaves), [F.col(k).eqNullSafe(F.col(lv[i])) for i, k in enumerate(LEVELS)])
    full, rest, stop = (F.col(lv[i]) for i in (3, 4, 5))
    before = (rest > 0) & (stop.isNull() | (_key(seed, full + 1, id_, text_hash) < stop))
    most = full + before.cast("int")
    d = d.withColumn("budget", F.col(lv[6])).where(most >= 1).withColumn("epoch", F.explode(F.sequence(F.lit(1), most)))
    return d.drop(*lv)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", *LEVELS, "n_tokens", "budget", "epoch")
