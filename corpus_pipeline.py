"""From raw documents to a sharded training mix: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import decontaminate, langid, mixing, neardup, sharding
from rillgraph.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language ID rejects documents without a letter and those whose best language has less than this share of their words.
LEAST_SHARE = 0.35
#: Of the words that remain, and at most so many epochs of a leaf, the mixture takes:
FRACTION, EPOCHS, SHARDS = 0.9, 1, 40
#: Different texts that have copies are broadcast up to this many (16 bytes each), and shuffled beyond.
MOST_BROADCAST = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    found = langid.identify(docs, langid.fit(docs), COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word Jaccard similarity of 0.8 or more): that with the smallest id, null ids
    last; of rows that share it, that with the smallest MD5 of the text."""
    rows, roots = neardup.groups(docs.select(*COLUMNS))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.col("text").cast("binary")), F.xxhash64(*COLUMNS), "_row")
    nodes = rows.groupBy("_node").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    nodes = nodes.join(roots, F.col("_node") == F.col("node"), "left").withColumn("_component", F.coalesce("root", "_node"))
    groups = nodes.groupBy("_component").agg(F.min("_least").alias("_first"), F.sum("_rows").alias("_all")).where("_all > 1")
    kept = cut(nodes.join(groups, "_component").select(F.col("_node").alias("_member"), F.col("_first._row").alias("_kept")), "kept")
    small = F.broadcast if kept.count() <= MOST_BROADCAST else (lambda x: x)
    return rows.join(small(kept), F.col("_node") == F.col("_member"), "left").where("_kept is null or _kept = _row").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id"), "_text_md5").distinct()
    at = docs["doc_id"].eqNullSafe(hit["_id"]) & F.md5(docs["text"].cast("binary")).eqNullSafe(hit["_text_md5"])
    return docs.join(hit, at, "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take."""
    return mixing.mix(docs.select(*COLUMNS), fraction=FRACTION, epochs=EPOCHS).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, shard and place in it."""
    return sharding.shard(docs.select(*COLUMNS), SHARDS)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]
#: The first stage learns a model, which SQL can't express; tests hold the stages after it, and their run, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
