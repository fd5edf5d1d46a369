"""Scalar functions: hashes for partitioning, CSV text, nulls, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def string_hash(*fields: str) -> Column:
    return F.xxhash64(*[F.col(f).cast("string") for f in fields])


def ip_hash(field: str) -> Column:
    return string_hash(field)


def unsigned_hash(field: str) -> Column:
    return F.col(field).cast("long")


def last_octet_hash(field: str) -> Column:
    """The last part of a dotted address as a number; null if it is none."""
    return F.substring_index(field, ".", -1).try_cast("long")


def time_hash(field: str) -> Column:
    return (F.col(field) * 1e7).cast("long")


HASHES = {"StringHashFunction": string_hash, "TupleStringHashFunction": string_hash, "IpHashFunction": ip_hash, "UnsignedIntHashFunction": unsigned_hash, "LastOctetHashFunction": last_octet_hash, "TimeConversionFunction": time_hash}


def partition(df: DataFrame, n: int, *hashes: Column) -> DataFrame:
    """One exchange on the hashes; no edge is copied."""
    return df.repartition(n, *hashes)


def first_element(line: Column) -> Column:
    return F.substring_index(line, ",", 1)


def without_first(line: Column) -> Column:
    return F.when(F.instr(line, ",") > 0, F.substring(line, F.instr(line, ",") + 1, F.length(line))).otherwise(F.lit(""))


def tokens(line: Column) -> Column:
    return F.split(line, ",", -1)


def tuple_text(*columns: str) -> Column:
    return F.to_csv(F.struct(*columns))


def mean_and_deviation(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
