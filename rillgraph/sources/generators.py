"""Deterministic synthetic netflow: spark.range and seeded hashes, so that a rerun of a lost task gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.schemas import VAST_NETFLOW


def uniform(seed: int, salt: int) -> Column:
    """In [0, 1), from the row's id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def _flow(ids: DataFrame, rate: float = 10.0, **columns: Column) -> DataFrame:
    base = {f.name: F.lit(1).cast(f.dataType) for f in VAST_NETFLOW.fields}
    base |= {"TimeSeconds": F.col("id") / F.lit(rate), "SourceIp": F.lit("192.168.0.1"), "DestIp": F.lit("192.168.0.2")} | columns
    return ids.select(F.col("id").alias("edge_id"), *[base[f.name].cast(f.dataType).alias(f.name) for f in VAST_NETFLOW.fields])


def popular_sites(spark: SparkSession, n: int, popular: int = 2, p: float = 0.5, sites: int = 100_000, seed: int = 1) -> DataFrame:
    """With chance p a destination among `popular` ones, else any."""
    site = F.when(uniform(seed, 0) < p, F.concat(F.lit("popular"), (uniform(seed, 1) * popular).cast("int"))).otherwise(F.concat(F.lit("site"), (uniform(seed, 2) * sites).cast("int")))
    return _flow(spark.range(n), DestIp=site)


def uniform_dest_port(spark: SparkSession, n: int, ports: int = 10, seed: int = 1) -> DataFrame:
    return _flow(spark.range(n), DestPort=(uniform(seed, 0) * ports).cast("int"))


def random_pool(spark: SparkSession, n: int, vertices: int, rate: float = 100.0, seed: int = 1) -> DataFrame:
    """Edges between random members of a pool."""
    node = lambda salt: F.concat(F.lit("node"), (uniform(seed, salt) * vertices).cast("int"))
    return _flow(spark.range(n), rate, SourceIp=node(0), DestIp=node(1), DurationSeconds=F.lit(0.0))


def random_flows(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Addresses that hardly ever recur."""
    ip = lambda s: F.concat_ws(".", *[(uniform(seed, s + i) * 256).cast("int").cast("string") for i in range(4)])
    return _flow(spark.range(n), SourceIp=ip(0), DestIp=ip(10), SrcPayloadBytes=(uniform(seed, 20) * 10_000).cast("long"))


def one_pair(spark: SparkSession, n: int, mean: float = 1000.0, deviation: float = 100.0, seed: int = 1) -> DataFrame:
    """One pair of hosts with normally distributed sizes (Box-Muller)."""
    z = F.sqrt(-2 * F.log(F.lit(1.0) - uniform(seed, 0))) * F.cos(2 * F.pi() * uniform(seed, 1))
    return _flow(spark.range(n), SrcPayloadBytes=F.greatest(F.lit(0), F.round(F.lit(mean) + deviation * z)).cast("long"))


def servers_and_clients(spark: SparkSession, examples: int, servers: int = 2, others: int = 3, ports: int = 100, seed: int = 1) -> DataFrame:
    """examples flows to each host in turn: servers are asked on two ports only, the others on any of `ports`."""
    hosts = servers + others
    host = F.col("id") % hosts
    port = F.when(host < servers, (uniform(seed, 0) * 2).cast("int") * 363 + 80).otherwise(1024 + (uniform(seed, 1) * ports).cast("int"))
    name = F.concat(F.when(host < servers, F.lit("server")).otherwise(F.lit("host")), host.cast("string"))
    return _flow(spark.range(examples * hosts), DestIp=name, DestPort=port)


def in_turn(flows: Sequence[DataFrame], edge_id: str = "edge_id") -> DataFrame:
    """The flows of several generators, one of each in turn: the i-th of the j-th has the id i * (their number) + j."""
    parts = [f.withColumn(edge_id, F.col(edge_id) * len(flows) + j) for j, f in enumerate(flows)]
    return reduce(DataFrame.unionByName, parts)


def watering_hole(spark: SparkSession, n: int, clients: int = 1000, servers: int = 5, attacks: int = 5, rate: float = 100.0, seed: int = 1) -> DataFrame:
    """Clients visit popular servers; planted clients then contact a controller that no one else does."""
    every = max(2, n // (attacks + 1))
    planted = (F.col("id") % every == every - 1) & (F.floor(F.col("id") / every) < attacks)
    client = F.concat(F.lit("client"), (uniform(seed, 0) * clients).cast("int"))
    victim = F.concat(F.lit("victim"), F.floor(F.col("id") / every).cast("string"))
    visit = (F.col("id") % every == every - 2) & (F.floor(F.col("id") / every) < attacks)
    return _flow(spark.range(n), rate, SourceIp=F.when(planted | visit, victim).otherwise(client), DestIp=F.when(planted, F.lit("controller")).otherwise(F.concat(F.lit("server"), (uniform(seed, 1) * servers).cast("int"))), DurationSeconds=F.lit(0.0))
