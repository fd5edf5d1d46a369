"""Offline analytics on feature matrices."""

import pytest
from pyspark.sql import functions as F

from rillgraph import ml


@pytest.fixture(scope="module")
def matrix(spark):
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    d = spark.range(600).select(F.col("id").alias("edge_id"), (u(1) < 0.3).cast("int").alias("label"), u(2).alias("noise"), u(3).alias("weak"))
    return d.withColumn("strong", F.col("label") + 0.3 * F.col("noise")).withColumn("weak", F.col("weak") + 0.3 * F.col("label")).cache()


def test_split_holds_half_of_the_positives(matrix):
    a, b = ml.split_at_half_positives(matrix)
    pos = lambda d: d.where("label = 1").count()
    assert a.count() + b.count() == 600 and abs(pos(a) - pos(b)) <= 1
    assert a.agg(F.max("edge_id")).first()[0] < b.agg(F.min("edge_id")).first()[0]


def test_split_of_ids_that_are_far_apart(spark):
    ids = [3, 5, 10**12, 10**12 + 1, 10**17, 10**17 + 5, -4]
    d = spark.createDataFrame([(i, 1) for i in ids] + [(i + 1, 0) for i in ids], "edge_id long, label int")
    a, b = ml.split_at_half_positives(d)
    assert sorted(r.edge_id for r in a.where("label = 1").collect()) == [-4, 3, 5]
    assert ml.split_at_half_positives(d.where("label = 0"))[0].count() == 0


def test_forest_ranks_and_cuts(matrix):
    a, b = ml.split_at_half_positives(matrix)
    out = ml.evaluate(a, b, ["strong", "noise"], trees=5)
    assert out["areaUnderROC"] > 0.99 and out["areaUnderPR"] > 0.99 and 0 < out["cutoff"] < 1
    weak = ml.evaluate(a, b, ["noise"], trees=5)
    assert weak["areaUnderROC"] < 0.7


def test_selection_takes_the_strong_feature_first(matrix):
    assert [f for f, _ in ml.forward_selection(matrix, ["noise", "strong"], most=1, trees=3)] == ["strong"]


def test_clusters(spark):
    rows = [(float(c * 100 + i % 5), float(c * 50 + i % 3)) for c in range(3) for i in range(30)] + [(1000.0, -900.0)]
    out = ml.cluster(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], ks=(3, 4))
    assert [r["k"] for r in out] == [3, 4] and out[0]["cost"] > out[1]["cost"] >= 0 and out[1]["silhouette"] > 0.9 and all(r["anomalies"] >= 0 for r in out)


def test_degrees_and_ranking(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")], "src string, dst string")
    assert {(r.src, r.fan_out) for r in ml.fan_out(e, "src", "dst").collect()} == {("a", 2), ("b", 1)}
    assert {(r.fan_out, r.sources) for r in ml.degree_histogram(e, "src", "dst").collect()} == {(2, 1), (1, 1)}
    s = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.9)], "v string, p double")
    assert [(r.v, round(r.mean_score, 3), r.n) for r in ml.rank_vertices(s, "v", "p").collect()] == [("b", 0.9, 1), ("a", 0.3, 2)]


def test_sample_by_class(matrix):
    a, b = (ml.sample_by_class(matrix, "label", {0: 0.1, 1: 1.0}).select("edge_id", "label").collect() for _ in range(2))
    assert a == b and sum(r.label for r in a) == matrix.where("label = 1").count() and 10 < sum(1 - r.label for r in a) < 90
