"""Queries over the driver tables and their SQL twins. Windows are small, so that rows leave them at these scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph import ml
from rillgraph.operators import histogram, sequential, topk, transform, windows
from rillgraph.operators.histogram import shape
from rillgraph.plans.language import Planner
from rillgraph.plans.pattern import Pattern, count_triangles, match, triangle
from rillgraph.functions import scalars

N, K, B, TOP = 10, 2, 5, 2
KEY = ["user_id"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream: edge_id, ts, user_id, event_type, value, k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def graph(spark: SparkSession, sf_dir: str, nodes: int) -> DataFrame:
    return events(spark, sf_dir).select("edge_id", (F.col("user_id") % nodes).alias("src"), (F.col("k") % nodes).alias("dst"), (F.unix_micros("ts") / 1e6).alias("t"), F.lit(0.0).alias("dur"), "event_type", "user_id")


def r(c, digits: int = 4):
    """Rounded; the small shift decides ties alike whatever the order of a floating-point sum. The SQL has it too."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, digits)


E = "select event_id as edge_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) / 1e6 as t from events"
W = f"(partition by user_id order by ts, edge_id rows between {N - 1} preceding and current row)"
WK = "(partition by user_id order by ts, edge_id)"


@query(f"with e as ({E}) select edge_id, user_id, round(sum(value) over w + 1e-7, 4) as sum_value, round(avg(value) over w + 1e-7, 4) as ave_value, round(var_pop(value) over w + 1e-7, 4) as var_value, round(max(value) over w + 1e-7, 4) as max_value, round(min(value) over w + 1e-7, 4) as min_value from e window w as {W}")
def exact_features(spark, d):
    e = events(spark, d)
    for op in ("sum", "ave", "var", "max", "min"):
        e = windows.exact(e, f"{op}_value", op, "value", N, KEY)
    return e.select("edge_id", "user_id", *[r(f"{op}_value").alias(f"{op}_value") for op in ("sum", "ave", "var", "max", "min")])


@query(f"with e as ({E}) select edge_id, (sum(k) over {W})::bigint as simple_sum from e")
def simple_sum(spark, d):
    return windows.exact(events(spark, d), "simple_sum", "simplesum", "k", N, KEY).select("edge_id", "simple_sum")


@query(f"with e as ({E}) select edge_id, value as identity_value, case when event_type = 'purchase' then 1.0::double else 0.0::double end as label_value from e")
def identity_and_label(spark, d):
    e = windows.identity(events(spark, d), "identity_value", "value")
    return windows.label_feature(e.withColumn("Label", F.col("event_type") == "purchase")).select("edge_id", "identity_value", "label_value")


@query(f"with e as ({E}) select edge_id, round(quantile_cont(value, 0.5) over {W} + 1e-7, 4) as median_value, round(quantile_cont(value, 0.9) over {W} + 1e-7, 4) as p90_value from e")
def window_median(spark, d):
    e = windows.exact(events(spark, d), "median_value", "median", "value", N, KEY)
    return windows.quantile(e, "p90_value", "value", 0.9, N, KEY).select("edge_id", r("median_value").alias("median_value"), r("p90_value").alias("p90_value"))


@query(f"with e as ({E}) select edge_id, len(list_distinct(list(event_type) over {W}))::bigint as distinct_types, len(list_distinct(list(k) over {W}))::bigint as distinct_k from e")
def count_distinct_exact(spark, d):
    e = windows.exact(events(spark, d), "distinct_types", "countdistinct", "event_type", N, KEY)
    return windows.exact(e, "distinct_k", "countdistinct", "k", N, KEY).select("edge_id", "distinct_types", "distinct_k")


@query(f"""with recursive e as ({E}), p as (select user_id, edge_id, k, row_number() over {WK} as n from e),
r as (select user_id, n, edge_id, [{{'v': k, 's': 0}}] as held from p where n = 1
  union all select p.user_id, p.n, p.edge_id, case when list_contains(list_transform(kept, lambda x: x.v), p.k) then kept else list_append(kept, {{'v': p.k, 's': cast(((p.n - 1) // {N // 5}) % 5 as integer)}}) end
  from (select user_id, n, case when n % {N // 5} = 0 then list_filter(held, lambda x: x.s <> (n // {N // 5}) % 5) else held end as kept from r) r join p on p.user_id = r.user_id and p.n = r.n + 1)
select edge_id, len(held)::bigint as distinct_k from r""")
def count_distinct_rotating(spark, d):
    return sequential.rotating_distinct(events(spark, d).select("edge_id", "ts", "user_id", "k"), "distinct_k", "k", N, KEY).select("edge_id", "distinct_k")


@query(f"with e as ({E}) select edge_id, len(list_distinct(list(k) over {W}))::bigint as distinct_k, true as near from e")
def count_distinct_approx(spark, d):
    """The sketch's estimate lies within three standard errors (5 % each), or a value, of the truth."""
    e = windows.exact(events(spark, d), "approx_k", "approxdistinct", "k", N, KEY)
    e = windows.exact(e, "distinct_k", "countdistinct", "k", N, KEY)
    return e.select("edge_id", "distinct_k", (F.abs(F.col("approx_k") - F.col("distinct_k")) <= F.greatest(F.lit(1.0), 0.15 * F.col("distinct_k"))).alias("near"))


@query(f"""with recursive e as ({E}), w as (select edge_id, list_sort(list(value) over {W}) as s from e),
r as (select edge_id, s, s[len(s) // 4 + 1] as a, s[3 * len(s) // 4 + 1] as b, 0 as i, len(s) <= 2 as done from w
  union all select edge_id, s, na, nb, i + 1, na = a and nb = b from (select *, coalesce(list_aggregate(list_filter(s, lambda x: abs(x - a) <= abs(x - b)), 'median'), a) as na, coalesce(list_aggregate(list_filter(s, lambda x: abs(x - a) > abs(x - b)), 'median'), b) as nb from r where i < 20 and not done)),
l as (select edge_id, arg_max(s, i) as s, arg_max(a, i) as a, arg_max(b, i) as b from r group by 1)
select edge_id, round(case when len(s) <= 2 then s[1] else least(a, b) end + 1e-7, 4) as low, round(case when len(s) <= 2 then s[2] else greatest(a, b) end + 1e-7, 4) as high from l""")
def k_medians(spark, d):
    e = sequential.kmedian(events(spark, d).select("edge_id", "ts", "user_id", "value"), "medians", "value", N, 2, KEY)
    return e.select("edge_id", r(F.get("medians", F.lit(0))).alias("low"), r(F.get("medians", F.lit(1))).alias("high"))


L, C = shape(N, K)
M = f"case when n <= {C} then n else n - {1 << L} * ((n - {C} - 1) // {1 << L} + 1) end"
EH = f"""with e as ({E}), p as (select *, row_number() over {WK} as n from e), m as (select *, {M} as m from p),
j as (select a.edge_id, a.m, sum(b.value) as s, avg(b.value) as a, var_pop(b.value) as v from m a join m b on a.user_id = b.user_id and b.n > a.n - a.m and b.n <= a.n group by 1, 2)
select edge_id, round(s + 1e-7, 4) as eh_sum, round(a + 1e-7, 4) as eh_ave, round(v + 1e-7, 4) as eh_var from j"""


@query(EH)
def eh_features(spark, d):
    e = histogram.features(events(spark, d), "value", N, K, KEY, {"sum": "eh_sum", "ave": "eh_ave", "var": "eh_var"})
    return e.select("edge_id", *[r(c).alias(c) for c in ("eh_sum", "eh_ave", "eh_var")])


TYPE = ["event_type"]
WT = "(partition by event_type order by ts, edge_id rows between {} preceding and current row)"
#: The default window, which fills at sf0.1, and one that fills at sf0.01.
DEFAULT_N, WIDE_N = 10_000, 500


def _wide_sql(n: int) -> str:
    return f"with e as ({E}) select edge_id, round(sum(value) over w + 1e-7, 3) as sum_value, round(avg(value) over w + 1e-7, 4) as ave_value, round(var_pop(value) over w + 1e-7, 3) as var_value, max(value) over w as max_value, min(value) over w as min_value, count(distinct user_id) over w as distinct_users from e window w as {WT.format(n - 1)}"


def _wide(spark, d, n):
    e = windows.place(events(spark, d), "at", TYPE)  # five keys: no task sorts all of one
    e = windows.several(e, {f"{op}_value": op for op in ("sum", "ave", "var", "max", "min")}, "value", n, TYPE, ranges="at")
    e = windows.exact(e, "distinct_users", "countdistinct", "user_id", n, TYPE, ranges="at")
    return e.select("edge_id", r("sum_value", 3).alias("sum_value"), r("ave_value").alias("ave_value"), r("var_value", 3).alias("var_value"), "max_value", "min_value", "distinct_users")


@query(_wide_sql(WIDE_N))
def exact_features_500(spark, d):
    return _wide(spark, d, WIDE_N)


@query(_wide_sql(DEFAULT_N))
def exact_features_10000(spark, d):
    return _wide(spark, d, DEFAULT_N)


@query(f"with e as ({E}) select edge_id, round(sum(value) over w + 1e-7, 3) as sum_value, round(var_pop(value) over w + 1e-7, 3) as var_value, max(value) over w as max_value from e window w as (order by ts, edge_id rows between {WIDE_N - 1} preceding and current row)")
def one_group_500(spark, d):
    """Windows over the whole stream: no task sorts all of it."""
    e = windows.place(events(spark, d), "at", [], ranges=32)
    for op in ("sum", "var", "max"):
        e = windows.exact(e, f"{op}_value", op, "value", WIDE_N, [], ranges="at")
    return e.select("edge_id", r("sum_value", 3).alias("sum_value"), r("var_value", 3).alias("var_value"), "max_value")


def _wide_eh_sql(n: int) -> str:
    levels, c = shape(n, K)
    step, w = 1 << levels, WT.format("(m - 1)")
    return f"with e as ({E}), p as (select *, row_number() over (partition by event_type order by ts, edge_id) as n from e), m as (select *, case when n <= {c} then n else n - {step} * ((n - {c} - 1) // {step} + 1) end as m from p) select edge_id, round(sum(value) over w + 1e-7, 3) as eh_sum, round(avg(value) over w + 1e-7, 4) as eh_ave, round(var_pop(value) over w + 1e-7, 3) as eh_var from m window w as {w}"


def _wide_eh(spark, d, n):
    e = histogram.features(events(spark, d), "value", n, K, TYPE, {"sum": "eh_sum", "ave": "eh_ave", "var": "eh_var"})
    return e.select("edge_id", r("eh_sum", 3).alias("eh_sum"), r("eh_ave").alias("eh_ave"), r("eh_var", 3).alias("eh_var"))


@query(_wide_eh_sql(WIDE_N))
def eh_features_500(spark, d):
    return _wide_eh(spark, d, WIDE_N)


@query(_wide_eh_sql(DEFAULT_N))
def eh_features_10000(spark, d):
    return _wide_eh(spark, d, DEFAULT_N)


TN = 20
HELD = TN // B - 1
TOPK = f"""e as ({E}), p as (select *, row_number() over {WK} as n from e), q as (select *, (n - 1) // {B} as d from p),
c as (select user_id, d, event_type as v, count(*) as c from q group by all),
k as (select *, row_number() over (partition by user_id, d order by c desc, v) as r from c),
s as (select x.user_id, x.d, k.v, sum(k.c) as c from (select distinct user_id, d from q) x join k on x.user_id = k.user_id and k.r <= {TOP} and k.d < x.d and k.d >= x.d - {HELD} group by all),
l as (select user_id, d, list(v order by c desc, v) as vs, list(c / (least(d, {HELD}) * {B}) order by c desc, v) as fs from s group by all),
t as (select q.*, l.vs, l.fs from q left join l on q.user_id = l.user_id and q.d = l.d)"""


def _top(spark, d):
    return topk.topk(events(spark, d), "top", "event_type", TN, B, TOP, KEY)


@query(f"with {TOPK} select edge_id, array_to_string(vs, ',') as top_keys, round(fs[1] + 1e-7, 4) as top1, round(fs[2] + 1e-7, 4) as top2 from t")
def block_topk(spark, d):
    return _top(spark, d).select("edge_id", F.array_join(topk.keys_of("top"), ",").alias("top_keys"), r(topk.value_at("top", 0)).alias("top1"), r(topk.value_at("top", 1)).alias("top2"))


ONE_GROUP = TOPK.replace(f"e as ({E})", f"e as (select * replace (0 as user_id) from ({E}))")


@query(f"with {ONE_GROUP} select edge_id, array_to_string(vs, ',') as top_keys, round(fs[1] + 1e-7, 4) as top1 from t")
def one_group_topk(spark, d):
    """Top-k over the whole stream, in blocks that are numbered in ranges."""
    e = topk.topk(events(spark, d), "top", "event_type", TN, B, TOP, [], ranges=32)
    return e.select("edge_id", F.array_join(topk.keys_of("top"), ",").alias("top_keys"), r(topk.value_at("top", 0)).alias("top1"))


@query(f"with {TOPK} select edge_id, user_id, event_type from t where round(fs[1] + fs[2], 9) > 0.7")
def filter_on_topk(spark, d):
    return transform.keep(_top(spark, d), F.round(topk.value_at("top", 0) + topk.value_at("top", 1), 9) > 0.7).select("edge_id", "user_id", "event_type")


@query(f"""with e as ({E}), p as (select *, row_number() over {WK} as n from e),
w as (select a.edge_id, a.n, list(b.k::double) filter ((b.n - 1) % {N} < {N // 2}) as x, list(b.k::double) filter ((b.n - 1) % {N} >= {N // 2}) as y from p a join p b on a.user_id = b.user_id and b.n between a.n - {N - 1} and a.n group by 1, 2),
h as (select edge_id, list_distinct(case when n >= {N // 2} then x else list_append(x, 0.0) end) as x, list_distinct(case when n >= {N} then y else list_append(coalesce(y, []), 0.0) end) as y from w)
select edge_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) + 1e-7, 4) as similarity from h""")
def self_similarity(spark, d):
    return sequential.similarity(events(spark, d), "similarity", "k", N, KEY).select("edge_id", r("similarity").alias("similarity"))


@query(f"""with e as ({E}), p as (select edge_id, user_id, event_type, row_number() over (partition by event_type order by ts, edge_id) as n from e),
w as (select edge_id, n, list(user_id::double) filter ((n - 1) % {WIDE_N} < {WIDE_N // 2}) over v as x, list(user_id::double) filter ((n - 1) % {WIDE_N} >= {WIDE_N // 2}) over v as y from p window v as (partition by event_type order by n rows between {WIDE_N - 1} preceding and current row)),
h as (select edge_id, list_distinct(case when n >= {WIDE_N // 2} then x else list_append(coalesce(x, []), 0.0) end) as x, list_distinct(case when n >= {WIDE_N} then y else list_append(coalesce(y, []), 0.0) end) as y from w)
select edge_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) + 1e-7, 4) as similarity from h""")
def self_similarity_500(spark, d):
    return sequential.similarity(events(spark, d), "similarity", "user_id", WIDE_N, TYPE, ranges=64).select("edge_id", r("similarity").alias("similarity"))


@query(f"""with e as ({E}), x as (select *, lag(value, 2) over {WK} as before from e), w as (select edge_id, corr(value, before) over {W} as c, count(before) over {W} as n, list(k) over {W} as l from x)
select edge_id, case when n > 1 and not isnan(c) then round(c + 1e-7, 4) end as correlation, round(len(list_filter(list_distinct(l), lambda v: len(list_filter(l, lambda u: u = v)) = 1)) / len(list_distinct(l)) + 1e-7, 4) as rarity from w""")
def autocorrelation_and_rarity(spark, d):
    e = windows.autocorrelation(events(spark, d), "correlation", "value", 2, N, KEY)
    return windows.exact(e, "rarity", "rarity", "k", N, KEY).select("edge_id", r("correlation").alias("correlation"), r("rarity").alias("rarity"))


LAPSE = f"e as ({E}), x as (select edge_id, ts, user_id, event_type, coalesce(t - lag(t) over (partition by user_id, event_type order by ts, edge_id), 0) as diff from e)"


def _lapse(spark, d):
    e = events(spark, d).withColumn("t", F.unix_micros("ts") / 1e6)
    return transform.time_lapse(e, "t", ["user_id", "event_type"], "diff")


@query(f"with {LAPSE} select edge_id, user_id, event_type, round(diff + 1e-7, 3) as time_diff from x")
def time_lapse(spark, d):
    return _lapse(spark, d).select("edge_id", "user_id", "event_type", r("diff", 3).alias("time_diff"))


@query(f"""with {LAPSE}, y as (select *, sum(diff) over (partition by user_id, event_type order by ts, edge_id rows between {N - 1} preceding and current row) as f from x),
a as (select a.edge_id, b.event_type, arg_max(b.f, b.edge_id) as f from y a join y b on a.user_id = b.user_id and b.edge_id <= a.edge_id group by 1, 2)
select edge_id, round(avg(f) + 1e-7, 2) as mean_f from a group by 1""")
def collapse_mean(spark, d):
    y = windows.exact(_lapse(spark, d), "f", "sum", "diff", N, ["user_id", "event_type"])
    return transform.collapse(y, "f", KEY, "event_type", mean="mean_f").select("edge_id", r("mean_f", 2).alias("mean_f"))


@query(f"with e as ({E}), l as (select user_id, event_type, arg_max(value, edge_id) as v from e group by all) select user_id, string_agg(event_type || '=' || round(v + 1e-7, 2)::varchar, ',' order by event_type) as latest, round(avg(v) + 1e-7, 4) as mean_latest from l group by 1")
def project_latest(spark, d):
    p = transform.project_latest(events(spark, d), "value", KEY, "event_type")
    mean = transform.collapse_map(p, "mean_latest", "value", lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x))
    text = F.array_join(F.transform(F.map_entries("value"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] + 1e-7, 2).cast("string"))), ",")
    return mean.select("user_id", text.alias("latest"), r("mean_latest").alias("mean_latest"))


@query(f"with e as ({E}), x as (select *, t - lag(t) over (partition by user_id order by ts, edge_id) as gap from e) select edge_id, coalesce(gap <= 600, false) as alive from x")
def time_to_live(spark, d):
    e = events(spark, d).withColumn("t", F.unix_micros("ts") / 1e6)
    return transform.within_ttl(e, "user_id", "t", 600).select("edge_id", "alive")


@query(f"""with {TOPK}, p2 as (select *, sum(value) over {W} as s, avg(value) over {W} as a from t) select edge_id, case when event_type = 'purchase' then 1.0::double else 0.0::double end as label, round(s + 1e-7, 4) as sum_value, round(a + 1e-7, 4) as ave_value, round(fs[1] + 1e-7, 4) as top1 from p2""")
def feature_matrix(spark, d):
    from rillgraph.sources.sinks import feature_matrix as matrix

    e = _top(spark, d).withColumn("top1", r(topk.value_at("top", 0))).withColumn("is_purchase", F.col("event_type") == "purchase")
    for op in ("sum", "ave"):
        e = windows.exact(e, f"{op}_value", op, "value", N, KEY).withColumn(f"{op}_value", r(f"{op}_value"))
    return matrix(e.withColumn("is_purchase", F.col("is_purchase").cast("int")), ["sum_value", "ave_value", "top1"], "is_purchase")


G = "select event_id as edge_id, user_id % {n} as src, cast(json_extract_string(props, '$.k') as bigint) % {n} as dst, epoch_us(ts) / 1e6 as t, event_type from events"


@query(f"with g as ({G.format(n=20)}) select a.edge_id as e1, b.edge_id as e2, c.edge_id as e3 from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 1200 join g c on b.dst = c.src and c.dst = a.src and c.t > b.t and c.t <= a.t + 1200")
def temporal_triangles(spark, d):
    return match(graph(spark, d, 20), triangle(1200)).select(*[F.col(f"{e}.edge_id").alias(e) for e in ("e1", "e2", "e3")])


@query(f"with g as ({G.format(n=10)}) select count(*) as triangles from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 3600 join g c on b.dst = c.src and c.dst = a.src and c.t > b.t and c.t <= a.t + 3600")
def triangle_count(spark, d):
    return count_triangles(graph(spark, d, 10), 3600)


@query(f"with g as ({G.format(n=500)}) select a.edge_id as e1, b.edge_id as e2, a.src as x, a.dst as y, b.dst as z from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 300 where b.event_type = 'purchase'")
def two_edge_path(spark, d):
    p = Pattern(300).edge("x", "e1", "y").edge("y", "e2", "z", where=F.col("event_type") == "purchase").time("start", "e1", "=", 0).time("start", "e2", ">", 0).time("start", "e2", "<", 300).time("end", "e1", "<=", 1e12).time("end", "e2", "<=", 1e12)
    p.time("end", "e1", ">=", 0).time("end", "e2", ">=", 0)
    return match(graph(spark, d, 500), p).select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"), "x", "y", "z")


HOT = f"hot as (select dst from g group by dst having count(*) >= (select 1.2 * count(*) / count(distinct dst) from g))"


@query(f"with g as ({G.format(n=100)}), {HOT} select a.edge_id as e1, b.edge_id as e2 from g a join g b on a.src = b.src and b.t > a.t and b.t <= a.t + 900 where a.dst in (select dst from hot) and b.dst not in (select dst from hot)")
def vertex_constraints(spark, d):
    g = graph(spark, d, 100)
    hot = g.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    hot = hot.join(g.agg((1.2 * F.count(F.lit(1)) / F.count_distinct("dst")).alias("least")), F.col("n") >= F.col("least")).select("dst")
    p = Pattern(900).edge("client", "e1", "site").edge("client", "e2", "other").time("start", "e1", "=", 0).time("start", "e2", ">", 0).time("start", "e2", "<", 900)
    p.time("end", "e1", ">=", 0).time("end", "e1", "<=", 1e12).time("end", "e2", ">=", 0).time("end", "e2", "<=", 1e12)
    p.vertex("site", True, hot).vertex("other", False, hot)
    return match(g, p).select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"))


@query(f"with g as ({G.format(n=500)}), f as (select src, count(distinct dst) as fan_out from g group by src) select fan_out, count(*) as sources from f group by 1")
def degree_histogram(spark, d):
    return ml.degree_histogram(graph(spark, d, 500), "src", "dst")


@query(f"with e as ({E}) select user_id, round(avg(value) + 1e-7, 4) as mean_score, count(*) as n from e group by 1")
def vertex_ranking(spark, d):
    return ml.rank_vertices(events(spark, d), "user_id", "value").withColumn("mean_score", r("mean_score"))


@query(f"with e as ({E}) select round(avg(value) + 1e-7, 6) as mean, round(stddev_pop(value) + 1e-7, 6) as deviation from e")
def mean_and_deviation(spark, d):
    return scalars.mean_and_deviation(events(spark, d), "value").select(r("mean", 6).alias("mean"), r("deviation", 6).alias("deviation"))


PROGRAM = f"""
WindowSize = {N}; Ehk = {K};
Flows = EventStream("localhost", 9999);
PARTITION Flows BY user_id; HASH user_id WITH IpHashFunction;
ByUser = STREAM Flows BY user_id;
Top = FOREACH ByUser GENERATE topk(event_type, {TN}, {B}, {TOP});
Busy = FILTER ByUser BY Top.value(0) + Top.value(1) > 0.7000001;
AveValue = FOREACH Busy GENERATE ave(value);
Pairs = STREAM Busy BY user_id, event_type;
Lapse = FOREACH Pairs TRANSFORM (t − t.prev(1)) : Diff;
LapseSum = FOREACH Lapse GENERATE simplesum(Diff, {N});
PerUser = COLLAPSE Lapse BY user_id FOR LapseSum;
MeanLapse = FOREACH PerUser GENERATE ave(LapseSum);
"""


def program(spark, d) -> Planner:
    _register()
    e = events(spark, d).withColumn("t", F.unix_micros("ts") / 1e6)
    return Planner({"Flows": e}, mode="exact").run(PROGRAM)


@query(f"with {TOPK}, f as (select * from t where fs[1] + fs[2] > 0.7000001) select edge_id, round(avg(value) over {W} + 1e-7, 4) as ave_value from f")
def language_filter_ave(spark, d):
    return program(spark, d).streams["Busy"].df.select("edge_id", r("AveValue").alias("ave_value"))


@query(f"""with {TOPK}, f as (select * from t where fs[1] + fs[2] > 0.7000001),
x as (select edge_id, ts, user_id, event_type, coalesce(t - lag(t) over (partition by user_id, event_type order by ts, edge_id), 0) as diff from f),
y as (select *, sum(diff) over (partition by user_id, event_type order by ts, edge_id rows between {N - 1} preceding and current row) as s from x),
a as (select a.edge_id, b.event_type, arg_max(b.s, b.edge_id) as s from y a join y b on a.user_id = b.user_id and b.edge_id <= a.edge_id group by 1, 2)
select edge_id, round(avg(s) + 1e-7, 2) as mean_lapse from a group by 1""")
def language_collapse(spark, d):
    return program(spark, d).streams["Lapse"].df.select("edge_id", r("MeanLapse", 2).alias("mean_lapse"))


SUBGRAPH = """
Flows = EventGraph("localhost", 9999);
SUBGRAPH ON Flows WITH source(src) AND target(dst) {
  x1 e1 x2; x2 e2 x3;
  start(e1) < start(e2);
  start(e2) - start(e1) <= 300;
  e2.event_type == "purchase";
}
"""


@query(f"with g as ({G.format(n=500)}) select a.edge_id as e1, b.edge_id as e2 from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 300 where b.event_type = 'purchase'")
def language_subgraph(spark, d):
    _register()
    return Planner({"Flows": graph(spark, d, 500)}).run(SUBGRAPH).matches[0].select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"))


@query(f"with e as ({E}) select edge_id, (user_id % 256)::bigint as octet, cast(t * 10 as bigint) as deci from e")
def hash_functions(spark, d):
    e = events(spark, d).withColumns({"ip": F.concat(F.lit("10.0.0."), F.col("user_id") % 256), "t": F.unix_micros("ts") / 1e6})
    seconds = F.round(scalars.time_hash("t") / 10) / 1e6  # t again: the hash is less than half a microsecond off
    return e.select("edge_id", scalars.last_octet_hash("ip").alias("octet"), F.rint(seconds * 10).cast("bigint").alias("deci"))  # a half goes to the even neighbour, as in the SQL's cast


EXPRESSIONS = f"""
Flows = EventStream("localhost", 9999);
ByUser = STREAM Flows BY user_id;
Load = FOREACH ByUser GENERATE sum(value * 2 + k, {N});
Norm = FOREACH ByUser GENERATE l2norm(value / 4, {N});
Odd = FILTER ByUser BY Load < 900 and k != 7 or value * 3 >= 270;
Kept = FOREACH Odd GENERATE max(k, {N});
"""


@query(f"with e as ({E}), l as (select *, sum(value * 2 + k) over {W} as s, sqrt(sum(value / 4 * value / 4) over {W}) as q from e), f as (select * from l where s < 900 and k <> 7 or value * 3 >= 270) select edge_id, round(s + 1e-7, 4) as load, round(q + 1e-7, 4) as norm, max(k) over {W} as most_k from f")
def language_expressions(spark, d):
    p = Planner({"Flows": events(spark, d)}, mode="exact")
    _register()
    return p.run(EXPRESSIONS).streams["Odd"].df.select("edge_id", r("Load").alias("load"), r("Norm").alias("norm"), F.col("Kept").alias("most_k"))


def _register() -> None:
    from pyspark.sql import types as T

    from rillgraph.schemas import register_schema

    register_schema("EventStream", T.StructType(), "t", "0.0", "user_id", "k")
    register_schema("EventGraph", T.StructType(), "t", "dur", "src", "dst")


KEYED = f"""
Flows = EventStream("localhost", 9999);
ByUser = STREAM Flows BY user_id;
Top = FOREACH ByUser GENERATE topk(event_type, {TN}, {B}, {TOP});
Buyers = FILTER ByUser BY Top.key(0) == "purchase" and Top.value(0) * 2 > 0.5;
"""


@query(f"with {TOPK} select edge_id, user_id from t where vs[1] = 'purchase' and fs[1] * 2 > 0.5000001")
def language_top_key(spark, d):
    _register()
    e = Planner({"Flows": events(spark, d)}).run(KEYED.replace("0.5;", "0.5000001;")).streams["Buyers"].df
    return e.select("edge_id", "user_id")


MEMBERS = """
Flows = EventGraph("localhost", 9999);
ByAll = STREAM Flows BY everything;
Top = FOREACH ByAll GENERATE topk(dst, 500, 50, 5);
SUBGRAPH ON Flows WITH source(src) AND target(dst) {
  client e1 site; client e2 other;
  site in Top; other not in Top;
  start(e1) < start(e2);
  start(e2) - start(e1) <= 3600;
}
"""


@query(f"""with g as ({G.format(n=30)}), p as (select *, row_number() over (order by t, edge_id) as n from g), q as (select *, (n - 1) // 50 as d from p),
c as (select d, dst::varchar as v, count(*) as c from q group by all), k as (select *, row_number() over (partition by d order by c desc, v) as r from c),
s as (select x.d, list(distinct k.v) as vs from (select distinct d from q) x join k on k.r <= 5 and k.d < x.d and k.d >= x.d - 9 group by 1),
t as (select q.*, s.vs from q left join s on q.d = s.d)
select a.edge_id as e1, b.edge_id as e2 from t a join t b on a.src = b.src and b.t > a.t and b.t <= a.t + 3600 where list_contains(a.vs, a.dst::varchar) and not list_contains(b.vs, b.dst::varchar)""")
def language_members(spark, d):
    _register()
    g = graph(spark, d, 30).withColumns({"ts": F.col("t"), "everything": F.lit(0)})
    return Planner({"Flows": g}, ranges=64).run(MEMBERS).matches[0].select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"))


INFO = """
Flows = EventGraph("localhost", 9999);
Hosts = VertexInfo("localhost", 9998);
SUBGRAPH ON Flows WITH source(src) AND target(dst) {
  a e1 b; b e2 c;
  start(e1) < start(e2);
  start(e2) - start(e1) <= 1800;
  Hosts(a).zone == Hosts(c).zone;
  Hosts(b).zone != 1;
}
"""


@query(f"with g as ({G.format(n=60)}) select a.edge_id as e1, b.edge_id as e2 from g a join g b on a.dst = b.src and b.t > a.t and b.t <= a.t + 1800 where a.src % 4 = b.dst % 4 and a.dst % 4 <> 1")
def language_vertex_info(spark, d):
    _register()
    hosts = spark.range(60).select(F.col("id").alias("host"), (F.col("id") % 4).alias("zone"))
    return Planner({"Flows": graph(spark, d, 60), "Hosts": hosts}).run(INFO).matches[0].select(F.col("e1.edge_id").alias("e1"), F.col("e2.edge_id").alias("e2"))


@query("with l as (select event_id, event_id || ',' || event_type || ',' || user_id as line from events) select event_id as edge_id, split_part(line, ',', 1) as head, substr(line, strpos(line, ',') + 1) as rest, len(string_split(line, ','))::int as fields, line as again from l")
def csv_helpers(spark, d):
    line = F.concat_ws(",", F.col("edge_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    e = events(spark, d).withColumn("line", line)
    return e.select("edge_id", scalars.first_element(F.col("line")).alias("head"), scalars.without_first(F.col("line")).alias("rest"), F.size(scalars.tokens(F.col("line"))).alias("fields"), scalars.tuple_text("edge_id", "event_type", "user_id").alias("again"))


@query(f"with e as ({E}), x as (select event_type, user_id, count(*) over (partition by event_type) as n from e) select event_type, count(distinct user_id) as fan_out from x group by 1")
def fan_out(spark, d):
    return ml.fan_out(events(spark, d), "event_type", "user_id")
