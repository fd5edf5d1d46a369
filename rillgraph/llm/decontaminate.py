"""Prefix-filtered set join: benchmark passages inside documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm.common import cut, discard, lower_ascii, table

NAME = "op3_decontaminate"
WINDOW = 10
#: What parts words: every ASCII character but digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fixed 2^20-bit filter of tokens (128 KB, whatever the benchmark's size); a false hit only costs a join row.
LONGS = 1 << 14
#: Benchmark windows are broadcast up to this many (about 400 bytes each), and shuffled beyond.
MOST_BROADCAST = 200_000


def words(text):
    return F.coalesce(F.filter(F.split(lower_ascii(text), GAPS), lambda w: w != ""), F.array().cast("array<string>"))


def _sieve(tokens: DataFrame, col: str):
    """A column function: may this token be one of them? Exact on no, one in 2^20 / tokens wrong on yes."""
    bits = tokens.select(F.pmod(F.xxhash64(col), F.lit(LONGS * 64)).alias("b")).distinct()
    rows = bits.groupBy((F.col("b") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).collect()  # at most LONGS rows
    longs = [0] * LONGS
    for r in rows:
        longs[r["at"]] = r["v"]
    held = F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L-1L)" for v in longs) + ")")

    def test(w):
        h = F.pmod(F.xxhash64(w), F.lit(LONGS * 64))
        return F.call_function("shiftright", F.get(held, F.shiftright(h, 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(words, items): every distinct window with the sorted ids of the items that have it."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    b = b.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return b.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, and `_text_md5`.

    A window (of an item: `window` consecutive words; a shorter item is one window) occurs where all its words follow each
    other in the document. Tokens are ordered by rarity (corpus frequency, then MD5): since a window must be contained
    whole, its prefix is its rarest token alone. Document words equal to a prefix token, and only those, are joined with the
    windows; the token's place in the window gives the only start there can be (positional bound), the window must lie
    inside the document (length bound), and the words around decide exactly.

    A single scan of the documents: words are sieved inside the row by a bit array of fixed size, survivors carry the words
    near them, and the grouping key is (id, MD5 of the text), so repeated rows give equal rows. Windows are broadcast only if
    counted to be at most MOST_BROADCAST, else the join shuffles and AQE splits a hot token; they are a table in the shared
    folder, which common.sweep removes once the result is consumed. Null or wordless texts have no
    words and no hits, null or wordless items no windows; either table may be empty. Other columns are not read.
    """
    wins = cut(item_windows(benchmark, window, item_col, item_text), "windows")
    vocab = wins.select(F.explode("win").alias("tok")).distinct()
    n_wins, n_vocab = wins.count(), vocab.count()
    small = F.broadcast if n_wins <= MOST_BROADCAST else (lambda x: x)
    tiny = F.broadcast if n_vocab <= MOST_BROADCAST else (lambda x: x)
    d = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("_text_md5"), words(F.col(text_col)).alias("w"))
    maybe = _sieve(vocab, "tok")
    seen = d.select(F.explode(F.filter("w", maybe)).alias("tok")).join(tiny(vocab), "tok").groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    rank = vocab.join(seen, "tok", "left").select("tok", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.col("tok").cast("binary")).alias("h"), "tok").alias("rank"))
    ranked = wins.select("win", "items", F.posexplode("win").alias("at", "tok")).join(tiny(rank), "tok")
    ranked = ranked.groupBy("win").agg(F.min(F.struct("rank", "at")).alias("p"), F.first("items").alias("items"))
    prefix = cut(ranked.select(F.col("p.rank.tok").alias("tok"), F.col("p.at").alias("at"), "win", F.size("win").alias("len"), "items"), "prefixes")
    discard(wins)  # prefix has them
    may_start = _sieve(prefix.select("tok").distinct(), "tok")
    near = F.transform("w", lambda w, i: F.when(may_start(w), i))
    own = F.expr("array(named_struct('pos', cast(null as int), 'tok', cast(null as string), 'near', cast(null as array<string>)))")  # one for each row
    cand = d.withColumn("_at", F.filter(near, lambda i: i.isNotNull()))
    cand = cand.select("id", "_text_md5", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(own, F.transform("_at", lambda i: F.struct(i.alias("pos"), F.get("w", i).alias("tok"), F.slice("w", F.greatest(i - (window - 1), F.lit(0)) + 1, 2 * window - 1).alias("near"))))).alias("c"))
    cand = cand.select("id", "_text_md5", "n_words", F.col("c.pos").alias("pos"), F.col("c.tok").alias("dtok"), F.col("c.near").alias("near"))
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.greatest(F.col("pos") - (window - 1), F.lit(0)) + 1, F.lit(1)), F.col("len")) == F.col("win")
    found = cand.join(small(prefix), (F.col("dtok") == F.col("tok")) & inside & same, "left")
    found = found.select("id", "_text_md5", "n_words", "pos", F.when(F.col("win").isNotNull(), F.struct(start.alias("s"), "len")).alias("span"), "items")
    # collect_set here holds at most a span for each word of one document, and the benchmark's item ids.
    per = found.groupBy("id", "_text_md5", "n_words").agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("pos").isNull()).alias("rows"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["s"], s["s"] + s["len"] - 1))))).cast("long")
    per = per.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    per = per.select("id", "_text_md5", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return per.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("_text_md5")


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
with d as (select doc_id, {_W} as w from documents),
b as (select cast(item_id as varchar) as item, {_W} as w from benchmark),
bw as (select distinct item, w[i:i + 9] as win from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct len(win) as n from bw),
dw as (select doc_id, i, n, w[i:i + n - 1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
h as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.win = bw.win),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on d.doc_id = p.doc_id left join t on d.doc_id = t.doc_id
"""
