"""Mixing against a direct computation of budgets and prefixes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillgraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def share(budget, kids):
    """kids: {name: (capacity, weight)}; gives in proportion to the weights, round by round, what the others can't take."""
    got, left = {k: 0.0 for k in kids}, budget
    while left > 1e-9 and (hungry := [k for k in kids if kids[k][1] > 0 and kids[k][0] - got[k] > 1e-9]):
        total = sum(kids[k][1] for k in hungry)
        step = min(left / total, min((kids[k][0] - got[k]) / kids[k][1] for k in hungry))
        for k in hungry:
            got[k] += step * kids[k][1]
        left -= step * total
    return got


def brute(rows, fraction, epochs, weights=mixing.WEIGHTS, seed=mixing.SEED):
    def domain(source):
        digits = (source or "")[len((source or "").rstrip("0123456789")) :]
        return f"dom{int(digits) % 4}" if digits else "domx"

    docs = [(domain(s), lang, s, i, t, len((t or "").split(" ")) - (t or "").split(" ").count("") if t else 0) for i, t, lang, s in rows]
    w = lambda level, v: weights.get(level, {}).get(v, min(weights.get(level, {}).values(), default=1.0))
    def cap(p):
        return epochs * sum(d[5] for d in docs if d[: len(p)] == p)

    nodes = {(): float(int(fraction * sum(d[5] for d in docs)))}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for p, b in nodes.items():
            kids = {d[: depth + 1] for d in docs if d[:depth] == p}
            for k, x in share(b, {k: (cap(k), w(level, k[-1])) for k in kids}).items():
                new[k] = x
        nodes = new
    out = []
    for leaf, b in nodes.items():
        budget, mine = int(b + 1e-6), [d for d in docs if d[:3] == leaf]
        left = budget
        for e in range(1, epochs + 1):
            key = lambda d: (hashlib.md5(f"{seed}/{e}/{'null' if d[3] is None else d[3]}".encode()).hexdigest())  # noqa: B023, E731
            order, groups = sorted(mine, key=key), []
            for d in order:  # repeated rows are one item
                if groups and groups[-1][0][3:5] == d[3:5]:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            if left <= 0:
                break
            for g in groups:
                n = sum(d[5] for d in g)
                if n > left:
                    left = -1
                    break
                left -= n
                out += [(d[3], d[4], d[0], d[5], budget, e) for d in g]
    return Counter(out)


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["s0", "s1", "s2", "s3", "s13", "web", None]) if rng.random() > 0.4 else "s0"  # a hot leaf
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))) or rng.choice(["", None]), rng.choice(["en", "de", "fr", "es", "xx", None]), source))
    rows += [(n, "a " * 3000, "en", "s1"), (n + 1, "same row here", "en", "s0"), (n + 1, "same row here", "en", "s0"), (n + 1, "same row here", "en", "s0")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("fraction,epochs", [(0.6, 2), (0.1, 1), (1.5, 2), (3.0, 2), (0.0, 1)])
def test_rows_and_budgets(spark, fraction, epochs):
    df, rows = table(spark)
    got = Counter((r.doc_id, r.text, r.domain, r.n_tokens, r.budget, r.epoch) for r in mixing.mix(df, fraction=fraction, epochs=epochs).collect())
    assert got == brute(rows, fraction, epochs)


def test_a_hot_leaf_is_narrowed_down(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 1)
    df, rows = table(spark, 300, 2)
    got = Counter((r.doc_id, r.text, r.domain, r.n_tokens, r.budget, r.epoch) for r in mixing.mix(df).collect())
    assert got == brute(rows, mixing.FRACTION, mixing.EPOCHS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    df, rows = table(spark, 100, 3)
    assert sum(brute(rows, 0.5, 2).values()) == mixing.mix(df, fraction=0.5).count()


def test_empty_and_clashing_columns(spark):
    df, rows = table(spark, 80, 4)
    assert mixing.mix(df.limit(0)).count() == 0
    want = brute(rows, 0.5, 2)
    for c in ("domain", "n_tokens", "budget", "epoch", "_full", "_k", "_part", "_edge", "_rest", "__domain", "__rest", "_i", "_h", "_t", "_j0"):
        df = df.withColumn(c, F.lit("mine"))
    got = mixing.mix(df, fraction=0.5).collect()
    assert Counter((r.doc_id, r.text, r.domain, r.n_tokens, r.budget, r.epoch) for r in got) == want
    assert all(r["_full"] == r["_k"] == r["__domain"] == r["_j0"] == "mine" for r in got)
