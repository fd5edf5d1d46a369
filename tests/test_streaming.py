from pyspark.sql import functions as F

from rillgraph.operators import histogram, topk, windows
from rillgraph.streaming import stateful


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.range(200).select(F.col("id").alias("edge_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 3).alias("key"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = drain(stateful.windowed(s, ["key"], "value", {"s": stateful.STEPS["sum"](5), "h": stateful.histogram_step(10, 2, "ave"), "t": stateful.topk_step(10, 5, 2), "p": stateful.STEPS["prev"](), "d": stateful.distinct_step(10)}), "features")
    b = windows.exact(e, "s", "sum", "value", 5, ["key"])
    b = histogram.features(b, "value", 10, 2, ["key"], {"ave": "h"})
    b = topk.topk(b, "t", "value", 10, 5, 2, ["key"]).withColumn("t", topk.value_at("t", 0))
    key = lambda d: sorted((r.edge_id, round(r.s, 6), round(r.h, 6), None if r.t is None or r.t != r.t else round(r.t, 6)) for r in d.collect())
    assert key(got) == key(b)


def test_follow_and_distinct(spark, tmp_path):
    e = spark.createDataFrame([(0, 0, "a", "b"), (1, 5, "b", "c"), (2, 50, "b", "d"), (3, 51, "b", "d")], "edge_id long, s long, src string, dst string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = drain(stateful.follow(s(), s(), "dst", "src", 10), "follow")
    assert [(r.a_edge_id, r.b_edge_id) for r in got.collect()] == [(0, 1)]
    assert drain(stateful.distinct_within(s(), ["src", "dst"], "1 hour"), "seen").count() == 3


def _batches(spark, path, parts):
    """One file, and so one micro-batch, for each part."""
    for i, d in enumerate(parts):
        d.coalesce(1).write.parquet(str(path / f"in/{i}"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path / "in"))


def test_state_passes_from_batch_to_batch(spark, tmp_path):
    e = spark.range(120).select(F.col("id").alias("edge_id"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), (F.col("id") % 2).alias("key"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    steps = {"s": stateful.STEPS["ave"](5), "m": stateful.STEPS["median"](4), "h": stateful.histogram_step(10, 2, "var"), "t": stateful.topk_step(10, 5, 2), "p": stateful.STEPS["prev"](), "d": stateful.distinct_step(10)}
    names = ["edge_id", *steps]
    plain = lambda d: [tuple(None if x != x else x for x in r) for r in d.select(*names).orderBy("edge_id").collect()]
    many = plain(drain(stateful.windowed(_batches(spark, tmp_path / "a", [e.where(f"edge_id div 17 = {i}") for i in range(8)]), ["key"], "value", steps), "many"))
    one = plain(drain(stateful.windowed(_batches(spark, tmp_path / "b", [e]), ["key"], "value", steps), "one"))
    assert many == one and len(one) == 120 and many[-1][1] is not None


def test_a_key_is_forgotten(spark, tmp_path):
    """Key 1 pauses beyond the limit; the key whose rows go on keeps its state."""
    row = lambda i, s, k: (i, s, k, 1.0)
    parts = [[row(0, 0, 1), row(1, 0, 2)], [row(2, 500, 2)], [row(3, 900, 2)], [row(4, 1300, 2)], [row(5, 1301, 1), row(6, 1302, 2)]]
    frames = [spark.createDataFrame(p, "edge_id long, s long, key long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s") for p in parts]
    for forget, last in ((600.0, 1.0), (None, 2.0)):
        out = drain(stateful.windowed(_batches(spark, tmp_path / str(forget), frames), ["key"], "value", {"s": stateful.STEPS["sum"](10)}, late="1 second", forget=forget), f"forgotten_{last:.0f}")
        got = {r.edge_id: r.s for r in out.collect()}
        assert (got[5], got[6]) == (last, 5.0)


def test_follow_meets_edges_of_nearby_times_only(spark, tmp_path):
    """A hub with edges over a long time: the join's key holds the time too, and no pair is lost or doubled at a bucket's end."""
    e = spark.range(400).select(F.col("id").alias("edge_id"), F.timestamp_micros(F.lit(7_000_000) + F.col("id") * F.col("id") % 997 * 250_000).alias("ts"), F.lit(1).alias("src"), F.lit(1).alias("dst"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    made = stateful.follow(s(), s(), "dst", "src", 10)
    got = sorted((r.a_edge_id, r.b_edge_id) for r in drain(made, "hub").collect())
    at = {i: 7_000_000 + i * i % 997 * 250_000 for i in range(400)}
    assert got == sorted((i, j) for i in at for j in at if at[i] < at[j] <= at[i] + 10_000_000)
    assert "bucket" in made._jdf.queryExecution().analyzed().toString()
