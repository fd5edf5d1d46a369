"""The language model against a direct computation."""

import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from rillgraph.llm import lm

SCHEMA = "doc_id long, text string, block int"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = []
    for i in range(n):
        at, text = rng.randrange(400), []
        for _ in range(rng.randint(1, 40)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, rng.randrange(400)])) % 400
            text.append(words[at])
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " \t".join(text), 3))
    return [*rows, (None, "w1 w2 w3", 3), (n, None, 3), (n + 1, "", 3), (n + 2, rows[0][1], 3), (n + 2, rows[0][1], 3), (n + 3, "w1 w2 " * 9000, 3)]


class Brute:
    def __init__(self, rows):
        self.docs = [(i, [*(t or "").lower().split(), "</s>"]) for i, t, _ in rows]
        rest = lambda i: 1 if i is None else zlib.crc32(str(i).encode()) % 10
        self.rest = [rest(i) for i, _ in self.docs]
        self.c, self.b, self.ctx = self.count(lambda r: r != 0)
        self.n, self.v = sum(self.c.values()), len(self.c)
        c, b, ctx = self.count(lambda r: r > 1)
        self.held = Counter()
        for r, (_, w) in zip(self.rest, self.docs, strict=True):
            if r == 1:
                for u, x in pairwise([None, *w]):
                    self.held[ctx[u], b[u, x], c[x]] += 1

    def count(self, on):
        c, b, ctx = Counter(), Counter(), Counter()
        for r, (_, w) in zip(self.rest, self.docs, strict=True):
            if on(r):
                c.update(w)
                b.update(pairwise([None, *w]))
                ctx.update([None, *w[:-1], w[-1]])
        return c, b, ctx

    def mix(self, w, cu, cb, cw):
        x = w[math.floor(math.log2(cu)) + 1 if cu else 0]
        return x[0] * cb / max(cu, 1) + x[1] * cw / self.n + x[2] / (self.v + 1)

    def likelihood(self, w):
        return sum(k * math.log(self.mix(w, *x)) for x, k in self.held.items())

    def learn(self, rounds=400):
        w = np.tile([0.6, 0.3, 0.1], (64, 1))
        w[0] = (0, 0.75, 0.25)
        for _ in range(rounds):
            new = np.zeros_like(w)
            for (cu, cb, cw), k in self.held.items():
                b = math.floor(math.log2(cu)) + 1 if cu else 0
                r = w[b] * [cb / max(cu, 1), cw / self.n, 1 / (self.v + 1)]
                new[b] += k * r / r.sum()
            on = new.sum(axis=1) > 0
            w[on] = new[on] / new[on].sum(axis=1, keepdims=True)
        return w


@pytest.fixture(scope="module")
def scored(spark):
    rows, found = corpus(), []
    learn, tokens = lm.learn_weights, lm.BLOCK_TOKENS
    lm.learn_weights, lm.BLOCK_TOKENS = lambda *a: found.append(learn(*a)) or found[0], 500
    try:
        got = lm.score(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        lm.learn_weights, lm.BLOCK_TOKENS = learn, tokens
    return Brute(rows), found[0], got


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_base_columns(scored):
    m, _, got = scored
    assert len(got) == len(m.docs)
    for r, (i, w), rest in zip(by_id(got), by_id(m.docs), [r for _, r in by_id(list(zip([i for i, _ in m.docs], m.rest, strict=True)))], strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, rest == 0, len(w), sum(m.c[x] > 0 for x in w), m.n)
        assert r.base_score == pytest.approx(sum(math.log10((m.c[x] + 0.1) / (m.n + 0.1 * (m.v + 1))) for x in w), rel=1e-9)


def test_scores_are_the_mixture(scored):
    m, weights, got = scored
    for r, (_, w) in zip(by_id(got), by_id(m.docs), strict=True):
        assert r.score == pytest.approx(sum(math.log10(m.mix(weights, m.ctx[u], m.b[u, x], m.c[x])) for u, x in pairwise([None, *w])), rel=1e-9)


def test_weights_are_those_of_em(scored):
    m, weights, _ = scored
    best, start = m.likelihood(m.learn()), m.likelihood(np.vstack([[0, 0.75, 0.25], np.tile([0.6, 0.3, 0.1], (63, 1))]))
    assert np.allclose(weights.sum(axis=1), 1) and best > start
    assert m.likelihood(weights) > best - 0.01 * (best - start)


def test_held_out_text_is_likelier_than_under_the_base(scored):
    _, _, got = scored
    held = [r for r in got if r.held_out and r.n_tokens < 1000]  # the planted long text is like no other
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.n_tokens for r in lm.score(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()] == [1]
