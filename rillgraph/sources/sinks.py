"""Sinks for feature matrices and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def feature_matrix(edges: DataFrame, features: list[str], label: str | None = None, edge_id: str = "edge_id") -> DataFrame:
    """(edge_id, label, features as doubles, in the order given); null where a feature is undefined."""
    first = [F.col(label).cast("double").alias("label")] if label else []
    return edges.select(edge_id, *first, *[F.col(f).cast("double").alias(f) for f in features])


def write_features(matrix: DataFrame, path: str, edge_id: str = "edge_id") -> None:
    """CSV without header: label first, then the features."""
    matrix.drop(edge_id).write.mode("overwrite").csv(path)


def match_text(edges: list[str]) -> Column:
    """A line for a match: each edge's id, time, duration, source and target."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{e}="), F.concat_ws(",", *[F.col(f"{e}.{f}").cast("string") for f in ("edge_id", "t", "dur", "src", "dst")])) for e in edges])


def write_matches(matches: DataFrame, edges: list[str], path: str) -> None:
    matches.select(match_text(edges).alias("value")).write.mode("overwrite").text(path)


def stream_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Exactly-once file sink over all that is available now."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
