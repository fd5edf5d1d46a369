"""Queries over sources, sinks, generators and streams; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.catalog import E, G, K, KEY, M, N, W, events, graph, query, r
from rillgraph.operators import transform, windows
from rillgraph.plans.pattern import Pattern, match
from rillgraph.schemas import INT_LABEL, NETFLOW_V5, VAST_NETFLOW, schema
from rillgraph.sources import generators, readers, sinks
from rillgraph.sources.shared import new_folder
from rillgraph.streaming import stateful


def _line(spark: SparkSession, d: str, struct, given: dict) -> DataFrame:
    """Events as CSV lines of a layout: the columns given, 1 in all others."""
    e = events(spark, d)
    return e.select("edge_id", *[given.get(f.name, F.lit(1)).cast("string").alias(f.name) for f in struct.fields])


def _vast(spark, d):
    at = F.unix_micros("ts")
    return _line(spark, d, VAST_NETFLOW, {
        "TimeSeconds": (at / 1e6).cast("decimal(20,6)"), "SourceIp": F.concat(F.lit("10.0.0."), F.col("user_id")), "DestIp": F.concat(F.lit("10.1.0."), F.col("k")), "DestPort": F.col("k") + 1000,
        "DurationSeconds": F.col("value").cast("decimal(20,2)"), "SrcTotalBytes": F.col("k") * 3, "IpLayerProtocolCode": F.col("event_type"),
    })


VAST = f"with e as ({E}) select edge_id, round(t + 1e-7, 3) as t, round(t + value + 1e-7, 3) as stop, '10.0.0.' || user_id as src, '10.1.0.' || k as dst, (k + 1000)::int as port, (k * 3)::bigint as bytes, event_type as protocol from e"


@query(VAST)
def vast_lines(spark, d):
    v = _vast(spark, d)
    lines = v.select("edge_id", F.concat(F.concat_ws(",", *VAST_NETFLOW.names), F.lit("\r")).alias("value"))
    s = schema("VastStream")
    e = readers.parse_lines(lines, s.struct)
    return e.select("edge_id", r(F.expr(s.time), 3).alias("t"), r(F.expr(s.time) + F.expr(s.duration), 3).alias("stop"), F.col(s.source).alias("src"), F.col(s.target).alias("dst"), F.col("DestPort").alias("port"), F.col("SrcTotalBytes").alias("bytes"), F.col("IpLayerProtocolCode").alias("protocol"))


@query(f"with e as ({E}) select edge_id as byte_count, case when event_type = 'error' then 1 else 0 end::int as label, '10.0.0.' || user_id as src, row_number() over (partition by user_id order by edge_id) as place from e")
def vast_files(spark, d):
    """Labelled files, written and read again: the ids give the order of files and lines."""
    v = _vast(spark, d).withColumn("SrcTotalBytes", F.col("edge_id"))
    v = v.join(events(spark, d).select("edge_id", (F.col("event_type") == "error").cast("int").alias("Label")), "edge_id")
    path = new_folder(spark, "vast")
    v.repartitionByRange("edge_id").sortWithinPartitions("edge_id").select("Label", *VAST_NETFLOW.names).write.csv(path)
    e = readers.read_csv(spark, path, VAST_NETFLOW, INT_LABEL)
    return e.select(F.col("SrcTotalBytes").alias("byte_count"), F.col("Label").alias("label"), F.col("SourceIp").alias("src"), F.row_number().over(windows.key_window(["SourceIp"], ["edge_id"])).cast("long").alias("place"))


@query(f"with e as ({E}) select edge_id, round(t + 1e-7, 3) as t, round((k * 250 - k * 50) / 1e3 + 1e-7, 3) as dur, '10.0.0.' || user_id as src, k::bigint as packets from e")
def netflow_v5_lines(spark, d):
    at = F.unix_micros("ts")
    v = _line(spark, d, NETFLOW_V5, {"UnixSecs": F.floor(at / 1_000_000), "UnixNsecs": at % 1_000_000 * 1000, "First1": F.col("k") * 50, "Last1": F.col("k") * 250, "SourceIp": F.concat(F.lit("10.0.0."), F.col("user_id")), "Dpkts": F.col("k")})
    s = schema("NetflowV5Stream")
    e = readers.parse_lines(v.select("edge_id", F.concat_ws(",", *NETFLOW_V5.names).alias("value")), s.struct)
    return e.select("edge_id", r(F.expr(s.time), 3).alias("t"), r(F.expr(s.duration), 3).alias("dur"), F.col(s.source).alias("src"), F.col("Dpkts").alias("packets"))


@query(f"""with e as ({E}) select edge_id as bytes, case when event_type = 'error' then 1 else 0 end::int as label, round(t + 1e-7, 3) as t, strftime(ts, '%Y%m%d%H%M%S.%f') as stamp,
case when k % 3 = 0 then 100000 else k end::int as sport, k::int as dport, round(value + 1e-7, 2) as dur from e""")
def argus_flows(spark, d):
    e = events(spark, d)
    one = F.lit(1)
    port = F.when(F.col("k") % 3 == 0, F.lit(" ")).otherwise(F.col("k").cast("string"))
    flows = e.select(
        F.when(F.col("event_type") == "error", "flow=From-Botnet-V1").otherwise("flow=Background").alias("label"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stime"), F.lit("tcp").alias("proto"),
        F.lit("a").alias("saddr"), F.lit("b").alias("daddr"), port.alias("sport"), F.concat(F.lit("0x"), F.hex("k")).alias("dport"), F.col("value").alias("dur"), *[one.cast("long").alias(c) for c in ("sappbytes", "dappbytes")], F.col("edge_id").alias("sbytes"), *[one.cast("long").alias(c) for c in ("dbytes", "spkts", "dpkts")],
    )
    v = readers.argus_to_vast(flows)
    return v.select(F.col("SrcTotalBytes").alias("bytes"), F.col("Label").alias("label"), r("TimeSeconds", 3).alias("t"), F.col("DateTime").alias("stamp"), F.col("SourcePort").alias("sport"), F.col("DestPort").alias("dport"), r("DurationSeconds", 2).alias("dur"))


@query(f"""with g as ({G.format(n=500)}), m as (select a.edge_id as e1, b.edge_id as e2, a.t as t1, b.t as t2, a.src as x, a.dst as y, b.dst as z from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 300)
select 'e1=' || e1 || ',' || t1::decimal(20,3) || ',0.0,' || x || ',' || y || '; e2=' || e2 || ',' || t2::decimal(20,3) || ',0.0,' || y || ',' || z as line from m""")
def match_lines(spark, d):
    p = Pattern(300).edge("x", "e1", "y").edge("y", "e2", "z").time("start", "e1", "=", 0).time("start", "e2", ">", 0).time("start", "e2", "<", 300)
    for e in ("e1", "e2"):
        p.time("end", e, ">=", 0).time("end", e, "<=", 1e12)
    plain = lambda e: F.col(e).withField("t", F.col(e)["t"].cast("decimal(20,3)")).withField("dur", F.col(e)["dur"].cast("decimal(4,1)"))
    return match(graph(spark, d, 500), p).withColumns({e: plain(e) for e in ("e1", "e2")}).select(sinks.match_text(["e1", "e2"]).alias("line"))


@query(f"with g as ({G.format(n=50)}) select a.edge_id as e1, b.edge_id as e2, b.dst as z from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 1800 where a.dst = 7")
def vertex_constant(spark, d):
    p = Pattern(1800).edge("x", "e1", "hub").edge("hub", "e2", "z").constant("hub", 7).time("start", "e1", "=", 0).time("start", "e2", ">", 0).time("start", "e2", "<", 1800)
    for e in ("e1", "e2"):
        p.time("end", e, ">=", 0).time("end", e, "<=", 1e12)
    return match(graph(spark, d, 50), p).select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"), "z")


@query(f"with e as ({E}), f as (select *, avg(value) over {W} as a from e), b as (select * from f where event_type = 'purchase'), x as (select e.edge_id, e.user_id, e.ts, e.event_type, b.a from e asof left join (select user_id, ts, max_by(a, edge_id) as a from b group by all) b on e.user_id = b.user_id and e.ts >= b.ts) select edge_id, round(a + 1e-7, 4) as latest from x where event_type = 'error'")
def feature_lookup(spark, d):
    """For each error, the average that its user's last purchase had."""
    e = events(spark, d)
    f = windows.exact(e, "average", "ave", "value", N, KEY).where("event_type = 'purchase'")
    asked = e.where("event_type = 'error'").select("edge_id", "user_id", "ts")
    return transform.lookup_latest(f, asked, "average", KEY).select("edge_id", r("average").alias("latest"))


@query(f"with e as ({E}), x as (select edge_id, user_id, nullif(k % 3, 0) as third from e) select edge_id, user_id from x where third is not null")
def subtuple_of_known(spark, d):
    e = events(spark, d).withColumn("third", F.nullif(F.col("k") % 3, F.lit(0)))
    return transform.subtuple(transform.keep(e, F.col("third").isNotNull()), "edge_id", "user_id")


@query("""select * from (values ('popular', 2000, 2000, true), ('ports', 2000, 2000, true), ('pool', 2000, 2000, true), ('pair', 2000, 1, true), ('watering hole', 2000, 5, true), ('servers', 500, 500, true), ('in turn', 4000, 4000, true)) t(generator, flows, planted, bounds)""")
def generated_flows(spark, d):
    """What each generator promises: the number of flows, how many are as planned, and whether all values keep their bounds."""
    g, n = generators, 2000
    contact = F.col("DestIp") == "controller"
    named = {
        "popular": (g.popular_sites(spark, n), F.col("DestIp").rlike("^(popular[01]|site[0-9]+)$"), F.lit(True)),
        "ports": (g.uniform_dest_port(spark, n), F.col("DestPort").between(0, 9), F.lit(True)),
        "pool": (g.random_pool(spark, n, 50), F.col("SourceIp").rlike("^node[0-4]?[0-9]$"), F.col("DestIp").rlike("^node[0-4]?[0-9]$")),
        "pair": (g.one_pair(spark, n), F.col("edge_id") == 0, (F.col("SrcPayloadBytes") >= 0) & (F.col("SourceIp") != F.col("DestIp"))),
        "watering hole": (g.watering_hole(spark, n), contact, ~contact | F.col("SourceIp").startswith("victim")),
        "servers": (g.servers_and_clients(spark, 100), F.lit(True), F.when(F.col("DestIp").startswith("server"), F.col("DestPort").isin(80, 443)).otherwise(F.col("DestPort") >= 1024)),
        "in turn": (g.in_turn([g.popular_sites(spark, n), g.uniform_dest_port(spark, n)]), F.when(F.col("edge_id") % 2 == 1, F.col("DestIp") == "192.168.0.2").otherwise(F.col("DestIp") != "192.168.0.2"), F.col("edge_id") < 2 * n),
    }
    out = None
    for name, (flows, planned, within) in named.items():
        one = flows.agg(F.lit(name).alias("generator"), F.count(F.lit(1)).cast("int").alias("flows"), F.count_if(planned).cast("int").alias("planted"), F.every(within).alias("bounds"))
        out = one if out is None else out.unionByName(one)
    return out


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(kind).parquet(f"{d}/event[s].parquet")  # a pattern, as the table may be one file
    return s.select(F.col("event_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _drain(stream: DataFrame, what: str) -> DataFrame:
    """All that is available now, through the exactly-once file sink."""
    spark = stream.sparkSession
    path = new_folder(spark, what)
    sinks.stream_to(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query(f"""with e as ({E}), p as (select *, row_number() over (partition by user_id order by ts, edge_id) as n, value - lag(value) over (partition by user_id order by ts, edge_id) as step from e), m as (select *, {M} as m from p),
h as (select edge_id, avg(value) over (partition by user_id order by ts, edge_id rows between (m - 1) preceding and current row) as h from m)
select edge_id, round(sum(value) over {W} + 1e-7, 4) as sum_value, max(value) over {W} as max_value, round(quantile_cont(value, 0.5) over {W} + 1e-7, 4) as median_value, round(h + 1e-7, 4) as eh_ave, round(step + 1e-7, 4) as step from p join h using (edge_id)""")
def stream_features(spark, d):
    steps = {"sum_value": stateful.STEPS["sum"](N), "max_value": stateful.STEPS["max"](N), "median_value": stateful.STEPS["median"](N), "eh_ave": stateful.histogram_step(N, K, "ave"), "step": stateful.STEPS["prev"]()}
    f = _drain(stateful.windowed(_stream(spark, d), KEY, "value", steps), "features")
    return f.select("edge_id", r("sum_value").alias("sum_value"), "max_value", r("median_value").alias("median_value"), r("eh_ave").alias("eh_ave"), r("step").alias("step"))


@query(f"with g as ({G.format(n=500)}) select a.edge_id as e1, b.edge_id as e2 from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 300")
def stream_paths(spark, d):
    s = lambda: _stream(spark, d).select("edge_id", "ts", (F.col("user_id") % 500).alias("src"), (F.col("k") % 500).alias("dst"))
    return _drain(stateful.follow(s(), s(), "dst", "src", 300), "paths").select(F.col("a_edge_id").alias("e1"), F.col("b_edge_id").alias("e2"))


@query(f"with e as ({E}) select distinct user_id, event_type from e")
def stream_distinct(spark, d):
    s = _stream(spark, d).select("user_id", "event_type", "ts")
    return _drain(stateful.distinct_within(s, ["user_id", "event_type"], "3650 days"), "seen").select("user_id", "event_type")
