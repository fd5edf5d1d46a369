"""The CRF against enumeration, and language identification on held-out texts."""

import itertools
import random

import numpy as np
import pytest

from rillgraph.llm import langid


def _enumerate(e, trans):
    """(posteriors, expected transitions, log partition) of one sequence by all its labellings."""
    T, K = e.shape
    weights = {ys: np.exp(sum(e[t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in itertools.pairwise(ys))) for ys in itertools.product(range(K), repeat=T)}
    z, post, moves = sum(weights.values()), np.zeros((T, K)), np.zeros((K, K))
    for ys, w in weights.items():
        for t, y in enumerate(ys):
            post[t, y] += w / z
        for a, b in itertools.pairwise(ys):
            moves[a, b] += w / z
    return post, moves, np.log(z)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths, K = np.array([6, 5, 5, 2, 1]), 3
    e, trans = rng.normal(0, 2, (6, 5, K)), rng.normal(0, 1.5, (K, K))
    post, moves, z = langid.forward_backward(e.copy(), lengths, trans, pairs=True)
    each = [_enumerate(e[:n, j], trans) for j, n in enumerate(lengths)]
    for j, n in enumerate(lengths):
        assert np.abs(post[:n, j] - each[j][0]).max() < 1e-9 and not post[n:, j].any()
    assert np.abs(moves - sum(m for _, m, _ in each)).max() < 1e-9
    assert z == pytest.approx(sum(x for _, _, x in each), abs=1e-9)


def test_gradient_of_the_partition_by_finite_differences():
    rng = np.random.default_rng(2)
    e, trans, lengths, h = rng.normal(0, 1, (4, 2, 3)), rng.normal(0, 1, (3, 3)), np.array([4, 3]), 1e-5
    post, moves, _ = langid.forward_backward(e.copy(), lengths, trans, pairs=True)
    z = lambda e, t: langid.forward_backward(e.copy(), lengths, t, pairs=True)[2]
    for i in np.ndindex(3, 3):
        d = np.zeros((3, 3))
        d[i] = h
        assert (z(e, trans + d) - z(e, trans - d)) / (2 * h) == pytest.approx(moves[i], abs=1e-7)
    for i in [(0, 0, 1), (3, 0, 2), (2, 1, 0)]:
        d = np.zeros(e.shape)
        d[i] = h
        assert (z(e + d, trans) - z(e - d, trans)) / (2 * h) == pytest.approx(post[i], abs=1e-7)


def test_long_sequences_stay_finite():
    post, _, _ = langid.forward_backward(np.random.default_rng(3).normal(0, 30, (20_000, 1, 4)), np.array([20_000]), np.full((4, 4), -50.0))
    assert np.isfinite(post).all() and np.allclose(post.sum(axis=2), 1)


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


def _corpus(spark, rng):
    rows = [(i, _text(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(["aa", "bb"] * 120 + ["cc"] * 8)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "bb"), (1003, _text(rng, "bb", 30_000), None), (None, _text(rng, "aa", 9), "aa"), (1004, rows[0][1], "aa"), (1004, rows[0][1], "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_identify(spark):
    rng = random.Random(5)
    df, rows = _corpus(spark, rng)
    model = langid.fit(df, sample=90)
    assert model.labels == ["aa", "bb", "cc"]  # a rare language is not left out
    got = langid.identify(df.withColumn("_text", df.lang), model, ["doc_id", "lang", "_text"]).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:-7]}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) >= 0.99 * len(truth)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] == "bb" and by[None][0] == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_code_switched_text(spark):
    rng = random.Random(6)
    df, _ = _corpus(spark, rng)
    model = langid.fit(df)
    mixed, want = [], []
    for lang in ["aa", "bb", "aa", "cc"] * 10:
        mixed += _text(rng, lang, 6).split()
        want += [lang] * 6
    r = langid.identify(spark.createDataFrame([(" ".join(mixed),)], "text string"), model, [], words=True).first()
    assert np.mean([a == b for a, b in zip(r.word_langs, want, strict=True)]) > 0.97
    share = want.count("aa") / len(want)
    assert r.lang_pred == "aa" and r.score == pytest.approx(share, abs=0.05)


def test_no_labels_no_rows_and_clashes(spark):
    df, _ = _corpus(spark, random.Random(7))
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0), None, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        langid.identify(df, None, ["lang_pred"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = langid.query(spark, sf).join(docs, "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99
