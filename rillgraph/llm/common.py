"""What the operators share: tables, shared storage, cutting lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.sources.shared import new_folder

#: Java regex of the characters that part words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of this process that are not removed yet.
_WRITTEN: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    path = new_folder(spark, what)
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rillgraph_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that cut() wrote and that no later plan reads."""
    for df in tables:
        path = getattr(df, "_rillgraph_path", None)
        if path:
            _remove(df.sparkSession, path)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Remove what the operators wrote to the shared folder after the first `since` folders. Results are lazy and read some of
    those tables: call it when they are consumed or written elsewhere."""
    for path in _WRITTEN[since:]:
        _remove(spark, path)


def tiled(sent: DataFrame, group: str, home: str, most: int, slim: DataFrame | None = None) -> DataFrame:
    """sent, groups in which every row with `home` is to meet every row, with `_tile`, `_point` and `_query`: inside
    (group, _tile) every point is to meet every query, and all tiles together hold each such meeting once. slim may give the
    same rows' group and home in a cheaper way, for the counts.

    A group of at most `most` rows is one tile. A larger one is a grid: its points are dealt to tile rows and all its rows, as
    queries, to tile columns, so no task holds more than about 2 `most` rows. At most one row for each large group is collected.
    """
    sizes = (sent if slim is None else slim).groupBy(group).agg(F.count(F.lit(1)).alias("q"), F.count_if(home).alias("p")).where(F.col("q") > most).collect()
    whole = sent.withColumns({"_tile": F.lit(0), "_point": F.col(home), "_query": F.lit(True)})
    if not sizes:
        return whole
    of = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r[group], -(-r[k] // most) or 1)]), F.col(group)), F.lit(1))
    h = F.xxhash64(*[F.col(c) for c in sent.columns if not isinstance(sent.schema[c].dataType, T.BinaryType)])
    big = sent.where(F.col(group).isin([r[group] for r in sizes])).withColumns({"_i": of("p"), "_j": of("q")})
    mine = F.pmod(h, F.col("_i")), F.pmod(F.xxhash64(h), F.col("_j"))
    points = big.where(home).withColumn("_o", F.explode(F.expr("sequence(0, _j - 1)"))).withColumns({"_tile": (mine[0] * F.col("_j") + F.col("_o")).cast("int"), "_point": F.lit(True), "_query": F.lit(False)})
    queries = big.withColumn("_o", F.explode(F.expr("sequence(0, _i - 1)"))).withColumns({"_tile": (F.col("_o") * F.col("_j") + mine[1]).cast("int"), "_point": F.lit(False), "_query": F.lit(True)})
    return whole.where(~F.col(group).isin([r[group] for r in sizes])).unionByName(points.drop("_i", "_j", "_o")).unionByName(queries.drop("_i", "_j", "_o"))


def lower_ascii(text):
    """Only A-Z become lower case. Pure ASCII texts take Spark's byte-wise lower(); translate() is for the others."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that links reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each is a pre-aggregated minimum and a join back to
    the edges, so a hub is never gathered in one task; each round is cut in the shared folder. Null ends are ignored.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").distinct()
    e, before = cut(e, "edges"), None
    for _ in range(most_rounds):
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, e = e, cut(small, "edges")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
