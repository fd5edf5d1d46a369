"""Operators against brute force on small tables with nulls, empty texts, repeated rows and extra columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.llm import chat, decontaminate, embeddings, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, size int"


def _docs(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), "en", f"s{i % 3}", 7) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "de", "s1", 7), (n + 2, "!?", "de", "s1", 7), (n + 3, rows[0][1], "en", "s0", 7), (n + 3, rows[0][1], "en", "s0", 7)]
    return spark.createDataFrame(rows, DOCS), rows


def _smallest(nodes, linked):
    root = {x: x for x in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash(spark):
    df, rows = _docs(spark, 40)
    fp = {i: simhash.fingerprint(t) for i, t, *_ in rows}
    want = _smallest(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows) and all(r.component == want[r.doc_id] and int(r.fingerprint, 16) == fp[r.doc_id] for r in got)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def _planted(bits, n, rng):
    """Random fingerprints, each with copies at up to 5 differing bits."""
    out = []
    for _ in range(n):
        f = rng.getrandbits(64)
        out.append(f)
        for _ in range(rng.randint(0, 3)):
            g = f
            for b in rng.sample(range(64), rng.randint(0, bits)):
                g ^= 1 << b
            out.append(g)
    return out


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_simhash_links_across_shards(spark, monkeypatch, most):
    """Planted neighbours meet, whatever shards they lie in; shards of over `most` rows are grids."""
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    fps = _planted(5, 400, random.Random(7))
    made = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: made)
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: r.component for r in simhash.simhash_components(made).collect()}
    assert got == {i: top(i) for i in range(len(fps))} and len(set(got.values())) < len(fps) - 100


def test_simhash_nulls_long_texts_and_other_columns(spark):
    long = "one two three four five six seven " * 20_000  # seven shingles: an added one tips no majority
    rows = [(1, None, 9), (2, "", 9), (3, " \t", 9), (None, "", 9), (None, "only null ids here", 9), (4, long, 9), (5, long + "end", 9), (6, "Ärger ABC", 9), (7, "Ärger abc", 9)]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component", F.lit(1))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {by[i].component for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert sorted(str(r.component) for r in got if r.doc_id is None) == ["1", "None"]
    assert int(by[4].fingerprint, 16) == simhash.fingerprint(long) and by[7].component == 6 and by[5].component == 4


def test_simhash_pairs_are_exact():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    p = np.concatenate([p, p ^ np.uint64(0b111), p ^ np.uint64(0b1111)])
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(p, p, 3) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(p)) for j in range(len(p)) if int(p[i] ^ p[j]).bit_count() <= 3}


def test_decontamination(spark):
    df, rows = _docs(spark)
    items = [("a", rows[3][1]), ("b", "w1 W2!"), ("c", None), ("d", "??"), ("e", rows[5][1][:80])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    wins = {k: [w[i : i + 10] for i in range(max(1, len(w) - 9))] for k, t in items if (w := split(t))}
    got = {r.doc_id: r for r in decontaminate.contamination(df, bench).collect()}
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for k, each in wins.items():
            for x in each:
                for at in range(len(w) - len(x) + 1):
                    if w[at : at + len(x)] == x:
                        hit |= set(range(at, at + len(x)))
                        found.add(k)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), bool(hit))
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [1 << 17, 25])
def test_embeddings(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "MOST_ROWS", most)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 32))
    x = np.concatenate([x, x[:20] + 0.25 * rng.standard_normal((20, 32)), x[:20] + 0.45 * rng.standard_normal((20, 32)), 3 * x[:5], x[:2], x[:1]])
    rows = [(i, v.tolist(), "mine") for i, v in enumerate(x)] + [(200, None, ""), (201, [0.0] * 32, ""), (202, [float("nan")] * 32, ""), (203, [None] * 32, ""), (204, [], ""), (205, [1.0, 2.0], ""), (206, [2.0, 4.0], ""), (207, [1e-300, 2e-300], ""), (208, [float("inf"), 1.0], "")]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert 20 < (near.sum() - len(x)) / 2 < 200 and np.abs(u @ u.T - 0.9).min() > 1e-9
    want = _smallest(range(len(x)), lambda a, b: near[a, b])
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string"))
    got = {r.vec_id: r for r in out.collect()}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (200, 201, 202, 203, 204, 208))
    assert all((got[i].n_links, got[i].component_id) == (2, 205) for i in (205, 206, 207))


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("3", 1, "3", True), ("3", 1, "3", True), ("4", 0, "4", True), ("None", 0, "None", True)]


def test_warc(spark):
    page = "x" * 200
    rows = [(1, "u", page), (2, "u", page), (3, None, "short"), (4, "u", "short"), (5, "u", None)]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got == {1: ("response", None, 200), 2: ("revisit", 1, 200), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0)}
    good = warc.record("response", 1, "u", b"abc")
    assert warc.parse(good)[1] == b"abc"
    for bad in (good[:-2], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"Other")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_chat_paths(spark):
    rng = random.Random(1)
    rows = [("m", 5, 99, None, None, None), ("cyc", 1, 2, "user", "a", 1.0), ("cyc", 2, 1, "user", "b", 1.0), (None, 1, None, "user", "a", 1.0)]
    for t in range(6):
        rows += [(str(t), i, None if i == 0 else rng.randrange(max(0, i - 3), i), "user", f"m{i}", float(rng.randint(0, 5))) for i in range(rng.choice([1, 2, 5, 30]))]
    want, trees = [], {}
    for t, m, p, _, _, s in rows:
        if t is not None:
            trees.setdefault(t, {})[m] = (p, s or 0.0)
    for t, ms in trees.items():
        found = []
        for leaf in set(ms) - {p for p, _ in ms.values()}:
            path, at = [], leaf
            while at in ms:
                path.append(at)
                at = ms[at][0]
            found.append((-sum(ms[x][1] for x in path), leaf, path))
        want += [(t, leaf, k, d, x) for k, (_, leaf, path) in enumerate(sorted(found)[:2], 1) for d, x in enumerate(reversed(path), 1)]
    df = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double")
    assert sorted(map(tuple, chat.paths(df, 2).select("tree", "leaf", "rank", "depth", "msg").collect())) == sorted(want)
