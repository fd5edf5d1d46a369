"""Golden values of the operators."""

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import histogram, sequential, topk, transform, windows


def rows(spark, values, key="a", kind="double"):
    return spark.createDataFrame([(i, float(i), key, float(v) if kind == "double" and v is not None else v) for i, v in enumerate(values)], f"edge_id long, ts double, key string, v {kind}")


def col(df, name):
    return [r[0] for r in df.orderBy("edge_id").select(name).collect()]


def test_simple_sum(spark):
    assert col(windows.exact(rows(spark, [1.0] * 19 + [2.0, 2.0]), "s", "simplesum", "v", 10, ["key"]), "s")[9:] == [10.0] * 10 + [11.0, 12.0]


@pytest.mark.parametrize("n,levels", [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (9, 2), (10, 3), (21, 3), (22, 4)])
def test_histogram_levels(n, levels):
    assert histogram.shape(n, 2)[0] == levels


def test_histogram_bounds():
    for n in (0, -1, 10_000_000):
        with pytest.raises(ValueError):
            histogram.shape(n, 2)
    assert [histogram.held(i, 21) for i in (1, 22, 23)] == [1, 22, 15]


def test_histogram_sum(spark):
    got = col(histogram.features(rows(spark, [1.0] * 23), "v", 21, 2, ["key"], {"sum": "s", "ave": "a", "var": "q"}).select("edge_id", "s"), "s")
    assert got == [*map(float, range(1, 23)), 15.0]


def test_histogram_against_window(spark):
    x = [float((7 * i * i) % 23) for i in range(120)]
    got = histogram.features(rows(spark, x), "v", 10, 2, ["key"], {"sum": "s", "ave": "a", "var": "q"}).orderBy("edge_id").select("s", "a", "q").collect()
    for i, (s, a, q) in enumerate(got):
        w = x[i + 1 - histogram.held(i + 1, 10) : i + 1]
        m = sum(w) / len(w)
        assert s == pytest.approx(sum(w)) and a == pytest.approx(m) and q == pytest.approx(sum((y - m) ** 2 for y in w) / len(w))


def test_block_topk(spark):
    x = ["1"] * 15 + ["2"] * 5 + ["3", "4"] + ["3"] * 8 + ["4"] + ["3"] * 9 + ["3"] * 11
    got = col(topk.topk(rows(spark, x, kind="string"), "t", "v", 50, 10, 2, ["key"]), "t")
    assert got[9] is None
    assert [tuple(r) for r in got[20]] == [("1", 0.75), ("2", 0.25)]
    assert [(r.key, round(r.frequency * 40)) for r in got[50]] == [("3", 28), ("1", 5), ("2", 5), ("4", 2)]


def test_block_validation():
    for n, b in ((1, 2), (-10, 2), (10, -2)):
        with pytest.raises(ValueError):
            topk.dormant(n, b)
    assert topk.dormant(10, 2) == 4 and topk.dormant(10, 3) == 2


def test_rotating_distinct(spark):
    got = col(sequential.rotating_distinct(rows(spark, [1.0] * 10 + [2.0, 3.0, 4.0, 1.0, 2.0]), "c", "v", 100, ["key"]), "c")
    assert got == [1] * 10 + [2, 3, 4, 4, 4]
    assert col(sequential.rotating_distinct(rows(spark, [1.0, 2.0, 3.0, 4.0]), "c", "v", 5, ["key"]), "c") == [1, 2, 3, 4]


def test_similarity(spark):
    x = [0.0, *range(1, 10), 0.0, 1, 2, 3, 4, 5, 1, 2, 8, 9, 0]
    got = col(sequential.similarity(rows(spark, list(map(float, x))), "s", "v", 10, ["key"]), "s")
    assert got[0] == 1.0
    assert col(sequential.similarity(rows(spark, [float(i) for i in [*range(1, 10), 0]]), "s", "v", 10, ["key"]), "s")[9] == 0.0
    assert col(sequential.similarity(rows(spark, [1.0, 2, 3, 4, 5, 1, 2, 8, 9, 0]), "s", "v", 10, ["key"]), "s")[9] == 0.25


def test_median_and_k_medians(spark):
    d = rows(spark, [1.0, 10.0, 10.0, 2.0])
    assert col(windows.exact(d, "m", "median", "v", 3, ["key"]), "m") == [1.0, 5.5, 10.0, 10.0]
    assert col(sequential.kmedian(d, "m", "v", 4, 2, ["key"]), "m")[3] == [1.5, 10.0]


def test_time_lapse_and_collapse(spark):
    assert col(transform.time_lapse(rows(spark, [0.0] * 100), "ts", ["key"]), "TimeDiff") == [0.0] + [1.0] * 99
    d = spark.createDataFrame([(0, 0.0, "k", "a", 12.0), (1, 1.0, "k", "b", 2.0), (2, 2.0, "k", "a", 4.0)], "edge_id long, ts double, key string, drop string, f double")
    out = transform.collapse(d, "f", ["key"], "drop", mean="m", var="q").orderBy("edge_id").select("m", "q").collect()
    assert [tuple(r) for r in out] == [(12.0, 0.0), (7.0, 25.0), (3.0, 1.0)]
    assert transform.project_latest(d, "f", ["key"], "drop").first()["f"] == {"a": 4.0, "b": 2.0}


def test_filter_drops_unknown(spark):
    d = topk.topk(rows(spark, ["a"] * 12, kind="string"), "t", "v", 10, 5, 1, ["key"])
    assert transform.keep(d, topk.value_at("t", 0) > 0.5).count() == 7
    assert transform.keep(d, topk.value_at("t", 3) > 0.5).count() == 0


def test_no_keys_is_one_group_and_keys_do_not_collide(spark):
    d = spark.createDataFrame([(0, 0.0, "1", "12", 1.0), (1, 1.0, "11", "2", 1.0)], "edge_id long, ts double, a string, b string, v double")
    assert col(windows.exact(d, "s", "sum", "v", 5, []), "s") == [1.0, 2.0]
    assert col(windows.exact(d, "s", "sum", "v", 5, ["a", "b"]), "s") == [1.0, 1.0]


def test_registered_operator(spark):
    windows.register_operator("range", lambda c, w: F.max(c).over(w) - F.min(c).over(w))
    assert col(windows.exact(rows(spark, [1.0, 4.0, 2.0]), "s", "range", "v", 2, ["key"]), "s") == [0.0, 3.0, 2.0]


def test_empty_and_null(spark):
    d = rows(spark, [None, 1.0, None])
    assert col(windows.exact(d, "s", "sum", "v", 2, ["key"]), "s") == [None, 1.0, 1.0]
    none = d.where("false")
    for out in (histogram.features(none, "v", 10, 2, ["key"], {"sum": "s"}), topk.topk(none, "t", "v", 10, 5, 1, ["key"]), sequential.rotating_distinct(none, "c", "v", 10, ["key"])):
        assert out.count() == 0


def test_histogram_after_large_values(spark):
    """A later sum doesn't depend on what has left the window."""
    x = [1e15] * 40 + [0.1 * (i % 7) for i in range(400)]
    got = histogram.features(rows(spark, x), "v", 20, 2, ["key"], {"sum": "s", "ave": "a", "var": "q"}).orderBy("edge_id").select("s", "a", "q").collect()
    for i, (s, a, q) in list(enumerate(got))[100:]:
        w = x[i + 1 - histogram.held(i + 1, 20) : i + 1]
        m = sum(w) / len(w)
        assert (s, a, q) == (pytest.approx(sum(w), rel=1e-12), pytest.approx(m, rel=1e-12), pytest.approx(sum((y - m) ** 2 for y in w) / len(w), rel=1e-9))


def test_histogram_keeps_all_columns(spark):
    d = rows(spark, [1.0, 2.0])
    for c in ("_n", "_v", "_m", "_x", "__row", "__block", "__value"):
        d = d.withColumn(c, F.lit("mine"))
    got = histogram.features(d, "v", 10, 2, [], {"var": "q"})
    assert got.columns == [*d.columns, "q"] and all(r["_n"] == r["_x"] == r["__row"] == "mine" for r in got.collect())


@pytest.mark.parametrize("op", windows.BLOCKWISE)
@pytest.mark.parametrize("n", [33, 50])
def test_blocks_equal_frames(spark, op, n):
    x = [None if i % 11 == 3 or 60 < i < 120 else float((i * i * 7) % 29) for i in range(260)]
    d = rows(spark, x).withColumn("key", F.when(F.col("edge_id") % 3 == 0, "b").otherwise("a")).withColumn("__row", F.lit(1))
    want = d.withColumn("f", windows.EXACT[op](F.col("v"), windows.last_rows(n, ["key"])))
    got = windows.exact(d, "f", op, "v", n, ["key"])
    assert got.columns == want.columns
    for a, b in zip(col(got, "f"), col(want, "f"), strict=True):
        assert a == b if b is None or op in ("count", "countdistinct") else a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert windows.exact(d.limit(0), "f", op, "v", n, ["key"]).count() == 0


def test_wide_windows_after_large_values(spark):
    x = [1e16] * 60 + [0.25] * 200
    for op, want in (("sum", 12.5), ("ave", 0.25), ("var", 0.0)):
        assert col(windows.exact(rows(spark, x), "f", op, "v", 50, ["key"]), "f")[-1] == want


@pytest.mark.parametrize("n", [2, 5, 10, 21])
def test_similarity_of_rings(spark, n):
    """Against a ring of slots that begins as zeros; nulls are zeros, and no working column meets the input's."""
    x = [None if i % 13 == 4 else float((i * i * 5 + i // 9) % 7 - 1) for i in range(150)]
    d = rows(spark, x).withColumn("key", F.when(F.col("edge_id") % 3 == 0, "b").otherwise("a")).withColumns({"__low": F.lit(1), "_ring": F.lit(2)})
    got = sequential.similarity(d, "s", "v", n, ["key"])
    assert got.columns == [*d.columns, "s"]
    rings, at, want = {}, {}, []
    for i, v in enumerate(x):
        key = "b" if i % 3 == 0 else "a"
        ring = rings.setdefault(key, [0.0] * n)
        ring[at.get(key, 0) % n] = v or 0.0
        at[key] = at.get(key, 0) + 1
        a, b = set(ring[: n // 2]), set(ring[n // 2 :])
        want.append(len(a & b) / len(a | b))
    assert col(got, "s") == pytest.approx(want)


def test_lookup_latest(spark):
    f = spark.createDataFrame([(0, 1.0, "a", 5.0), (1, 2.0, "a", 6.0), (2, 2.0, "a", None), (3, 1.0, None, 9.0), (4, 9.0, "b", 7.0)], "edge_id long, ts double, key string, f double")
    asked = spark.createDataFrame([("a", 0.5, 1), ("a", 1.0, 2), ("a", 1.5, 3), ("a", 2.0, 4), ("b", 8.0, 5), ("c", 9.0, 6), (None, 9.0, 7), ("a", 1.5, 3)], "key string, ts double, __row int")
    got = transform.lookup_latest(f, asked, "f", ["key"])
    assert got.columns == ["key", "ts", "__row", "f"]
    assert sorted((r["__row"], r.f) for r in got.collect() if r["__row"] != 3) == [(1, None), (2, 5.0), (4, None), (5, None), (6, None), (7, None)]
    assert [r.f for r in got.where("__row = 3").collect()] == [5.0, 5.0]


def test_autocorrelation_and_rarity(spark):
    d = rows(spark, [1.0, 2.0, 4.0, 3.0, 3.0, None, 1.0])
    assert col(windows.autocorrelation(d, "c", "v", 1, 4, ["key"]), "c")[:3] == [None, None, pytest.approx(1.0)]
    assert col(windows.autocorrelation(rows(spark, [2.0] * 4), "c", "v", 1, 4, ["key"]), "c") == [None] * 4
    assert col(windows.exact(d, "r", "rarity", "v", 3, ["key"]), "r") == [1.0, 1.0, 1.0, 1.0, 0.5, 0.0, 1.0]
    assert col(windows.exact(rows(spark, [None]), "r", "rarity", "v", 3, ["key"]), "r") == [None]


@pytest.mark.parametrize("op", [x for x in windows.BLOCKWISE if x != "countdistinct"])
def test_ranges_give_the_same(spark, monkeypatch, op):
    """A key over several ranges, ties of the order's first column, nulls in it, in the key and in the values."""
    x = [None if i % 11 == 3 or 60 < i < 90 else float((i * i * 7) % 29) for i in range(180)]
    d = rows(spark, x).withColumns({"key": F.when(F.col("edge_id") % 7 == 0, None).when(F.col("edge_id") % 3 == 0, "b").otherwise("a"), "ts": F.when(F.col("edge_id") > 4, F.floor(F.col("edge_id") / 9)), "__at": F.lit(1)})
    monkeypatch.setattr(windows, "CHUNK", 3)
    assert col(windows.place(d, "p", [], ranges=4), "p") == col(d.withColumn("p", F.row_number().over(windows.key_window([])) - 1), "p")
    for keys in (["key"], []):
        want = d.withColumn("f", windows.EXACT[op](F.col("v"), windows.last_rows(10, keys)))
        got = windows.exact(d, "f", op, "v", 10, keys, ranges=6)
        assert windows.exact(d, "f", op, "v", 1, keys, ranges=6).count() == 180
        assert got.columns == want.columns
        for a, b in zip(col(got, "f"), col(want, "f"), strict=True):
            assert a == b if b is None else a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert windows.exact(d.limit(0), "f", op, "v", 10, [], ranges=6).count() == 0
    with pytest.raises(ValueError):
        windows.exact(d, "f", "median", "v", 10, [], ranges=6)


@pytest.mark.parametrize("n", [10, 40, 300])
def test_distinct_sketch_of_few_values(spark, n):
    """Few values are counted one by one, in narrow and wide windows; many are estimated within three standard errors."""
    x = [None if i % 17 == 5 else float(i % 12 + 1000 * (i // 300)) for i in range(3000)] + [float(10_000 + i) for i in range(400)]
    d = rows(spark, x).withColumn("__held", F.lit(1))
    got = windows.exact(d, "f", "approxdistinct", "v", n, ["key"])
    assert got.columns == [*d.columns, "f"]
    for i, f in enumerate(col(got, "f")):
        want = len({v for v in x[max(0, i + 1 - n) : i + 1] if v is not None})
        assert f == want if want <= 48 else abs(f - want) <= 0.15 * want
    assert windows.exact(d.limit(0), "f", "approxdistinct", "v", n, ["key"]).count() == 0


@pytest.mark.parametrize("keys", [["key"], []])
def test_distinct_and_similarity_over_ranges(spark, keys):
    """Counted in blocks of ranges of the order: as by sets, with nulls, repeats, one hot value and equal times."""
    import random

    rng = random.Random(3)
    data = [(i, float(i // 3), "ab"[rng.random() < 0.3], rng.choice([None, 0.0, 1.0, 1.0, 1.0, *map(float, range(2, 9))])) for i in range(160)]
    d = spark.createDataFrame(data, "edge_id long, ts double, key string, v double").repartition(5)
    groups = {}
    for r in data:
        groups.setdefault(r[2] if keys else 0, []).append(r)
    for n in (2, 5, 40, 200):
        got = windows.exact(d, "c", "countdistinct", "v", n, keys, ranges=4).collect()
        want = {g[j][0]: len({x[3] for x in g[max(0, j - n + 1) : j + 1]} - {None}) for g in groups.values() for j in range(len(g))}
        assert {r.edge_id: r.c for r in got} == want and len(got) == len(data)
        ring = {}
        for g in groups.values():
            slots = [0.0] * n
            for j, x in enumerate(g):
                slots[j % n] = x[3] or 0.0
                lo, hi = set(slots[: n // 2]), set(slots[n // 2 :])
                ring[x[0]] = len(lo & hi) / len(lo | hi)
        got = sequential.similarity(d, "s", "v", n, keys, ranges=4).collect()
        assert {r.edge_id: round(r.s, 9) for r in got} == {k: round(x, 9) for k, x in ring.items()} and len(got) == len(data)


def test_several_features_share_their_blocks(spark):
    d = rows(spark, [float((7 * i * i) % 23) if i % 9 else None for i in range(150)])
    ops = ("sum", "ave", "var", "stddev", "max", "min", "count", "l2norm")
    e = d
    for op in ops:
        e = windows.exact(e, op, op, "v", 40, ["key"])
    several = windows.several(d, {op: op for op in ops}, "v", 40, ["key"], ranges=3)
    plain = lambda x: sorted(tuple(None if v is None else round(v, 9) for v in r) for r in x.select("edge_id", *ops).collect())
    assert plain(several) == plain(e)
