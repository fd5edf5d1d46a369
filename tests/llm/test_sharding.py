"""Sharding: every row once, gapless slots and even shards, whatever repeats."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillgraph.llm import sharding

SCHEMA = "doc_id long, text string"


def held(spark, rows, n_shards=40, **settings):
    """The rows of the result, after the checks that hold for every table."""
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards, **settings).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in got) and all(0 <= s < n_shards for s in by)
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in by.values())
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) < 2 * max(r["size"] for r in got)
    return got


@pytest.mark.parametrize("hot", [1, 16, 30])
def test_rows_that_repeat_for_a_third_of_the_table(spark, hot):
    rows = [(i, f"text {i}") for i in range(6000)] + [(-1 - i % hot, f"the same row {i % hot}") for i in range(3000)]
    held(spark, rows, per_range=1, seed=8)


def test_one_row_many_times(spark):
    held(spark, [(None, None)] * 500 + [(7, "x")] * 500, 4)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, i]), rng.choice([None, "", "word " * rng.randint(1, 30), "same", "z" * 20_000])) for i in range(400)]
    got = held(spark, rows, 7)
    import hashlib

    order = sorted(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "") + "/" + ("" if r[0] is None else str(r[0])))
    at, want, total = 0, {}, sum(len((t or "").encode()) + 16 for _, t in rows)
    for r in order:
        want.setdefault(r, []).append(at * 7 // total)
        at += len((r[1] or "").encode()) + 16
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.text), []).append(r.shard)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_few_rows_and_clashing_columns(spark):
    assert len(held(spark, [(1, "a")], 40)) == 1
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(i, f"t{i}") for i in range(50)], SCHEMA)
    for c in ("size", "shard", "slot", "_sb", "__key", "__range", "__offset", "_sk", "r", "_width"):
        d = d.withColumn(c, F.lit("mine"))
    got = sharding.shard(d, 3).collect()
    assert len(got) == 50 and all(r["_sb"] == r["__key"] == r["__range"] == r["__offset"] == r["_sk"] == r["r"] == r["_width"] == "mine" for r in got)


def test_query_digests(spark):
    got = sharding.query(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs) and all(r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r.grown_shard is None and r.law == "bytes" for r in got)
