"""Sources: labelled CSV files, line streams, converters, enrichment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.functions.columns import private
from rillgraph.schemas import NO_LABEL


def _typed(parsed: DataFrame, legacy_int_duration: bool) -> DataFrame:
    if legacy_int_duration and "DurationSeconds" in parsed.columns:
        parsed = parsed.withColumn("DurationSeconds", F.expr("cast(cast(DurationSeconds as bigint) as double)"))
    return parsed


def read_csv(spark: SparkSession, path: str, struct: T.StructType, label: T.StructType = NO_LABEL, legacy_int_duration: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Edges of a CSV file: label columns, then the tuple. edge_id follows the files' paths, then their lines."""
    full = T.StructType([*label.fields, *struct.fields])
    edges = spark.read.schema(full).option("mode", mode).csv(path)
    return _typed(in_file_order(edges), legacy_int_duration)


#: Bits of an edge_id for the place in a file: files of up to 1 TB, and up to 8 million of them.
PLACE_BITS = 40


def in_file_order(edges: DataFrame) -> DataFrame:
    """edges, as a reader of files made them, with edge_id: file by file in the order of paths, line by line.

    A split's rows are numbered from its offset in the file. No row is shorter than a byte, so the ids rise through the file
    and give one order however Spark splits and packs the files; the ids themselves depend on the splits. The numbering is one
    shuffle by split, of at most spark.sql.files.maxPartitionBytes each."""
    local = "^file:/+"  # Spark writes file:/ and file:///
    path, start, at, file = private(edges, "path", "start", "at", "file")
    d = edges.withColumns({path: F.regexp_replace("_metadata.file_path", local, "file:/"), start: F.col("_metadata.file_block_start"), at: F.monotonically_increasing_id()})
    files = sorted(re.sub(local, "file:/", f) for f in edges.inputFiles())
    if len(files) > 1 << 63 - PLACE_BITS:
        raise ValueError(f"{len(files)} files: too many to number")
    place = F.col(start) + F.row_number().over(Window.partitionBy(path, start).orderBy(at)) - 1
    if len(files) < 2:
        return d.select(place.alias("edge_id"), *[F.col(f"`{c}`") for c in edges.columns])
    ranks = edges.sparkSession.createDataFrame(list(enumerate(files)), f"{file} long, `{path}_` string")
    d = d.join(ranks, F.col(path) == F.col(f"{path}_"), "left")
    rank = F.coalesce(file, F.raise_error(F.concat(F.lit("not among the files listed: "), F.col(path))).cast("long"))
    return d.select((F.shiftleft(rank, PLACE_BITS) + place).alias("edge_id"), *[F.col(f"`{c}`") for c in edges.columns])


def parse_lines(lines: DataFrame, struct: T.StructType, label: T.StructType = NO_LABEL, column: str = "value") -> DataFrame:
    """Edges of text lines, batch or streaming; carriage returns are stripped, empty lines dropped, bad fields null."""
    full = T.StructType([*label.fields, *struct.fields])
    text = F.regexp_replace(column, "\r$", "")
    keep = [c for c in lines.columns if c != column]
    return lines.where(text != "").select(*keep, F.from_csv(text, full.simpleString()[7:-1].replace(":", " ")).alias("_e")).select(*keep, "_e.*")


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Streaming lines from a TCP server (development; use a replayable source such as files in production)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def read_line_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Streaming lines from files that arrive in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)


ARGUS = "label string, stime string, proto string, saddr string, daddr string, sport string, dport string, dur double, sappbytes long, dappbytes long, sbytes long, dbytes long, spkts long, dpkts long"


def argus_to_vast(argus: DataFrame) -> DataFrame:
    """Flow records of an Argus export as labelled VAST netflow: label 1 for botnet flows, empty ports 100000, hex ports read."""

    def port(c: str):
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", 100000).when(F.lower(c).startswith("0x"), F.conv(F.substring(F.col(c), 3, 16), 16, 10).cast("int")).otherwise(F.col(c).try_cast("int"))

    at = F.to_timestamp("stime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    zero = F.lit(0).cast("int")
    return argus.select(
        F.when(F.col("label").contains("Botnet"), 1).otherwise(0).alias("Label"), (F.unix_micros(at) / 1e6).alias("TimeSeconds"), F.col("stime").alias("ParseDate"), F.date_format(at, "yyyyMMddHHmmss.SSSSSS").alias("DateTime"),
        F.col("proto").alias("IpLayerProtocol"), F.col("proto").alias("IpLayerProtocolCode"), F.col("saddr").alias("SourceIp"), F.col("daddr").alias("DestIp"), port("sport").alias("SourcePort"), port("dport").alias("DestPort"),
        F.lit("0").alias("MoreFragments"), zero.alias("CountFragments"), F.col("dur").alias("DurationSeconds"), F.col("sappbytes").alias("SrcPayloadBytes"), F.col("dappbytes").alias("DestPayloadBytes"), F.col("sbytes").alias("SrcTotalBytes"),
        F.col("dbytes").alias("DestTotalBytes"), F.col("spkts").alias("FirstSeenSrcPacketCount"), F.col("dpkts").alias("FirstSeenDestPacketCount"), zero.alias("RecordForceOut"),
    )


def vertex_info(edges: DataFrame, info: DataFrame, vertex: str, key: str, prefix: str = "info_", most_rows: int = 100_000) -> DataFrame:
    """edges with the side table's columns for a vertex; broadcast only if the table is counted to be small."""
    side = info.select(F.col(key).alias("_v"), *[F.col(c).alias(prefix + c) for c in info.columns if c != key])
    small = info.limit(most_rows + 1).count() <= most_rows
    return edges.join(F.broadcast(side) if small else side, F.col(vertex) == F.col("_v"), "left").drop("_v")
