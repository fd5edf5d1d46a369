"""Built-in edge schemas and the registry of further ones."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"d": T.DoubleType(), "s": T.StringType(), "i": T.IntegerType(), "l": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


VAST_NETFLOW = _struct(
    "TimeSeconds:d ParseDate:s DateTime:s IpLayerProtocol:s IpLayerProtocolCode:s SourceIp:s DestIp:s SourcePort:i DestPort:i MoreFragments:s CountFragments:i "
    "DurationSeconds:d SrcPayloadBytes:l DestPayloadBytes:l SrcTotalBytes:l DestTotalBytes:l FirstSeenSrcPacketCount:l FirstSeenDestPacketCount:l RecordForceOut:i"
)
NETFLOW_V5 = _struct(
    "UnixSecs:l UnixNsecs:l SysUptime:l Exaddr:s Dpkts:l Doctets:l First1:l Last1:l EngineType:l EngineId:l SourceIp:s DestIp:s NextHop:s SnmpInput:l SnmpOutput:l "
    "SourcePort:l DestPort:l Protocol:l Tos:l TcpFlags:l SourceMask:l DestMask:l SourceAS:l DestAS:l"
)
TIME_LAPSE = _struct("DestIp:s SourceIp:s TimeDiff:d")
#: Label layouts that precede the tuple in a CSV line.
NO_LABEL, BOOL_LABEL, INT_LABEL = T.StructType(), T.StructType([T.StructField("Label", T.BooleanType())]), T.StructType([T.StructField("Label", T.IntegerType())])


@dataclass(frozen=True)
class EdgeSchema:
    """A tuple layout and the expressions for what patterns need of an edge."""

    name: str
    struct: T.StructType
    time: str
    duration: str
    source: str = "SourceIp"
    target: str = "DestIp"
    aliases: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.aliases.get(name, name))


_REGISTRY: dict[str, EdgeSchema] = {}


def register_schema(name: str, struct: T.StructType, time: str, duration: str, source: str, target: str, aliases: dict[str, str] | None = None) -> EdgeSchema:
    """Add a schema under a name that the query language's connection statements can use."""
    _REGISTRY[name] = EdgeSchema(name, struct, time, duration, source, target, aliases or {})
    return _REGISTRY[name]


def schema(name: str) -> EdgeSchema:
    return _REGISTRY[name]


register_schema("VastStream", VAST_NETFLOW, "TimeSeconds", "DurationSeconds", "SourceIp", "DestIp")
# V5 has seconds and nanoseconds apart, and first / last switched in milliseconds of uptime.
register_schema("NetflowV5Stream", NETFLOW_V5, "UnixSecs + UnixNsecs / 1e9", "(Last1 - First1) / 1e3", "SourceIp", "DestIp", {"First": "First1", "Last": "Last1"})
