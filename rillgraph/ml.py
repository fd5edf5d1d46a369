"""Offline analytics on feature matrices."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def split_at_half_positives(df: DataFrame, label: str = "label", order: str = "edge_id", parts: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the one that holds half of the positives, by a whole-number order column.

    The middle positive is found by counts over `parts` equal ranges, then over those of the range it lies in, and so on: an
    aggregate of at most that many rows each time, so nothing is sorted or gathered. Without positives all rows are in the
    second part.
    """
    pos = df.where(F.col(label) == 1).select(F.col(order).cast("decimal(20,0)").alias("x"))
    n, lo, hi = pos.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return df.where("false"), df
    lo, hi, rank = int(lo), int(hi), n // 2  # the positive with so many before it
    while hi > lo:
        width = -(-(hi - lo + 1) // parts)
        at = F.floor((F.col("x") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int").alias("p")
        for p, c in sorted(pos.where(F.col("x").between(lo, hi)).groupBy(at).count().collect()):
            if rank < c:
                lo, hi = lo + p * width, min(hi, lo + (p + 1) * width - 1)
                break
            rank -= c
    return df.where(F.col(order) < lo), df.where(F.col(order) >= lo)


def evaluate(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", trees: int = 50, seed: int = 1) -> dict[str, float]:
    """Random forest: area under ROC and PR, and the threshold whose ROC point is closest to (0, 1)."""
    model = RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed).fit(assemble(train, features))
    scored = model.transform(assemble(test, features))
    out = {m: BinaryClassificationEvaluator(labelCol=label, metricName=m).evaluate(scored) for m in ("areaUnderROC", "areaUnderPR")}
    p = scored.select(F.element_at(_to_array("probability"), 2).alias("p"), F.col(label).cast("double").alias("y"))
    cutoff = _closest_to_corner(p)
    return out | ({} if cutoff is None else {"cutoff": cutoff})


def _closest_to_corner(p: DataFrame, bins: int = 1000) -> float | None:
    """The score p at which the ROC point of (p, y) is closest to (0, 1), on the scores themselves.

    Counts by score bin give the points at the bins' edges. Only in a bin whose best corner (all its positives, none of its
    negatives) beats the closest edge can a point inside be closer; those bins alone are ordered by score, each apart.
    """
    b = p.withColumn("b", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    edges = sorted(b.groupBy("b").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp")).collect(), key=lambda r: -r["b"])  # at most `bins` rows
    tp, fp = sum(r["tp"] for r in edges), sum(r["fp"] for r in edges)
    if not tp or not fp:
        return None
    t = f = 0.0
    best, corner = float("inf"), {}
    for r in edges:
        corner[r["b"]] = ((1 - (t + r["tp"]) / tp) ** 2 + (f / fp) ** 2, t, f)
        t, f = t + r["tp"], f + r["fp"]
        best = min(best, (1 - t / tp) ** 2 + (f / fp) ** 2)
    inside = [(k, x[1], x[2]) for k, x in corner.items() if x[0] <= best]
    base = F.create_map(*[F.lit(v) for k, t0, f0 in inside for v in (k, t0)]), F.create_map(*[F.lit(v) for k, t0, f0 in inside for v in (k, f0)])
    each = b.where(F.col("b").isin([k for k, _, _ in inside])).groupBy("b", "p").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    w = Window.partitionBy("b").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = 1 - (base[0][F.col("b")] + F.sum("tp").over(w)) / tp
    y = (base[1][F.col("b")] + F.sum("fp").over(w)) / fp
    return each.select("p", (x * x + y * y).alias("d")).agg(F.min_by("p", F.struct("d", -F.col("p")))).first()[0]


def _to_array(c: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(c))


def forward_selection(df: DataFrame, features: list[str], most: int | None = None, label: str = "label", order: str = "edge_id", trees: int = 20) -> list[tuple[str, float]]:
    """Greedy: add the feature with the best mean AUC over both directions of the split."""
    a, b = (x.persist() for x in split_at_half_positives(df, label, order))
    chosen: list[tuple[str, float]] = []
    while len(chosen) < (most or len(features)):
        have = [f for f, _ in chosen]
        scores = {f: sum(evaluate(x, y, [*have, f], label, trees)["areaUnderROC"] for x, y in ((a, b), (b, a))) / 2 for f in features if f not in have}
        best = max(scores, key=lambda f: (scores[f], f))
        chosen.append((best, scores[best]))
    return chosen


def rank_vertices(scored: DataFrame, vertex: str, score: str) -> DataFrame:
    return scored.groupBy(vertex).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n")).orderBy(F.col("mean_score").desc(), vertex)


def cluster(df: DataFrame, features: list[str], ks: tuple[int, ...] = (3, 4, 5), seed: int = 1) -> list[dict[str, float]]:
    """k, cost (for the elbow), silhouette, and rows further than mean + 2 deviations from their centre."""
    d, out = assemble(df, features).persist(), []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(d)
        p = m.transform(d)
        centres = [c.tolist() for c in m.clusterCenters()]
        at = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("prediction") + 1)
        dist = F.sqrt(F.aggregate(F.zip_with(_to_array("features"), at, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        p = p.withColumn("d", dist)
        mean, dev = p.agg(F.avg("d"), F.stddev_pop("d")).first()
        out.append({"k": k, "cost": m.summary.trainingCost, "silhouette": ClusteringEvaluator().evaluate(p), "anomalies": p.where(F.col("d") > mean + 2 * dev).count()})
    return out


def fan_out(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.groupBy(src).agg(F.countDistinct(dst).alias("fan_out"))


def degree_histogram(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return fan_out(edges, src, dst).groupBy("fan_out").agg(F.count(F.lit(1)).alias("sources"))


def sample_by_class(df: DataFrame, label: str, fractions: dict, seed: int = 1) -> DataFrame:
    return df.sampleBy(label, fractions, seed)
