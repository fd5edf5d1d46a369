"""Stages of the corpus pipeline against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rillgraph.llm import neardup
from tests.llm.test_mixing import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def _near_copies(seed=3, n=25):
    """Texts with copies in which some words are changed, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(seed), ["", " ", "One two", "one  TWO", "three"]
    for _ in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 5)):
            x = list(w)
            for i in rng.sample(range(len(x)), rng.randint(0, len(x) // 30)):
                x[i] = f"v{rng.randrange(5000)}"
            out.append(" ".join(x))
    return out


def _classes(texts):
    sets, group = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _similar(sets[i], sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_dedup_finds_every_near_copy(spark):
    texts = _near_copies()
    want = sorted(set(_classes(texts)))
    assert 25 < len(want) < len(texts) - 20
    df = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_near_dedup_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)  # large clusters become grids
    monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
    texts = _near_copies(4, 12)
    df = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(set(_classes(texts)))


def _bits(words):
    """SimHash of the set of shingles: a bit is 1 if more than half of the hashes have it."""
    hashes = [xxhash.xxh64_intdigest(" ".join(w), 42) for w in words]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


@pytest.mark.parametrize("rows", [4096, 4])
def test_near_dedup_searches_fingerprints(spark, monkeypatch, rows):
    """Without the bands, near copies are those of a SimHash similarity of 0.8 or more, whatever shards and tiles they lie in."""
    monkeypatch.setattr(neardup, "bands", lambda h: np.empty(0, np.int64))
    monkeypatch.setattr(neardup, "LEAST_ROWS", rows, raising=False)
    texts = _near_copies(6)
    sets = [_shingles(t) for t in texts]
    bits = [_bits(x) for x in sets]
    cluster, want = list(range(len(texts))), list(range(len(texts)))
    for group, linked in ((cluster, lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 12), (want, lambda i, j: cluster[i] == cluster[j] and _similar(sets[i], sets[j]))):
        for i in range(len(texts)):
            for j in range(i):
                if linked(i, j) and group[i] != group[j]:
                    a, b = sorted((group[i], group[j]))
                    group[:] = [a if g == b else g for g in group]
    want = {w for w, x in zip(want, sets, strict=True) if x} | {min(i for i, x in enumerate(sets) if not x)}
    assert 25 < len(want) < len(texts) - 20
    df = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(want)


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, rng.integers(5, 60), dtype=np.uint64)
        for _ in range(rng.integers(1, 8)):
            x = base.copy()
            x[rng.random(len(x)) < 0.12] += np.uint64(rng.integers(1, 9))
            sets.append(np.unique(x))
    node, block = np.arange(len(sets)) * 7 + 3, rng.integers(0, 2, len(sets))
    for blocks in (np.zeros(len(sets), int), block):
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if _similar(set(sets[i].tolist()), set(sets[j].tolist())) and (blocks[i] != blocks[j] or not blocks.any()):
                    a, b = sorted((want[i], want[j]))
                    want = [a if g == b else g for g in want]
        got = list(range(len(sets)))
        for u, v in zip(*neardup.links_of(node, blocks, sets, 0.8), strict=True):
            a, b = sorted((got[(u - 3) // 7], got[(v - 3) // 7]))
            got = [a if g == b else g for g in got]
        assert got == want and len(set(want)) < len(sets)


def test_near_dedup_keeps_a_row_of_every_group(spark):
    clean = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[3]), (None, clean[4]), (9, clean[4]), (8, clean[5])]
    df = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == {(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (9, clean[4]), (8, clean[5])}


LETTERS = {"aa": "abcde", "bb": "fghij"}


def _prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))


def _items(texts, n=10):
    """All windows of the benchmark: n consecutive words, or a shorter item whole."""
    out = set()
    for t in texts:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        out |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def _hit(text, windows):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def _documents(rng, n=160):
    """Documents in two languages, copies and near copies, passages of the benchmark, texts without a letter."""
    bench = [_prose(rng, "aa", 25), _prose(rng, "bb", 4), "", None]
    rows = [(i, _prose(rng, "ab"[i % 2] * 2, rng.randint(40, 90)), "ab"[i % 2] * 2, f"s{i % 6}") for i in range(n)]
    rows += [(n + i, rows[i][1] + " " + _prose(rng, "aa", 1), "aa", "s0") for i in range(20)]  # near copies
    rows += [(n + 20 + i, rows[3][1], "bb", "s1") for i in range(30)]  # exact ones
    rows += [(n + 50 + i, _prose(rng, "aa", 30) + ". " + bench[i % 2].upper() + "! " + _prose(rng, "bb", 30), None, "s2") for i in range(8)]
    rows += [(n + 60, None, "aa", "s0"), (n + 61, "", "bb", None), (n + 62, "12 ?!", "aa", "s3"), (None, _prose(rng, "aa", 50), "aa", None), (5, _prose(rng, "bb", 50), "bb", "s1")]
    return [(*r, len(r[1] or "")) for r in rows], bench


def _order(r):
    return r[0] is None, r[0] or 0, r[1] or ""


def _plain(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=_order)


def test_language_stage_drops_texts_without_letters_only(spark):
    rows, _ = _documents(random.Random(11))
    df = spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in rows], SCHEMA).withColumn("score", F.lit("mine"))
    got = corpus_pipeline.language_id(spark, df, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert _plain(got) == sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=_order)
    assert corpus_pipeline.language_id(spark, df.limit(0), "").count() == 0


def test_decontamination_stage_against_brute_force(spark, tmp_path):
    rows, bench = _documents(random.Random(12))
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(bench)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows += [(None, bench[0], "aa", "s1", 1), (5, bench[0] + " and more", "aa", "s1", 1)]  # a null id, and an id that a clean text has too
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.decontamination(spark, df.withColumns({"_id": F.lit(1), "contaminated": F.lit(2)}), str(tmp_path))
    want = sorted((r for r in rows if not _hit(r[1], _items(bench))), key=_order)
    assert got.columns == corpus_pipeline.COLUMNS and _plain(got) == want and len(rows) - len(want) == 10
    assert corpus_pipeline.decontamination(spark, df.limit(0), str(tmp_path)).count() == 0


def test_mixing_stage_against_brute_force(spark):
    rows, _ = _documents(random.Random(13))
    want = brute([(i, t, lang, s) for i, t, lang, s, _ in rows], corpus_pipeline.FRACTION, corpus_pipeline.EPOCHS)
    got = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, SCHEMA).withColumn("budget", F.lit("mine")), "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=lambda r: _order(r)) == sorted(((i, t) for i, t, *_ in want.elements()), key=lambda r: _order(r))


def test_all_stages(spark, tmp_path):
    """Every stage takes effect in a run, and the last keeps all rows that the fourth leaves."""
    rows, bench = _documents(random.Random(14))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(bench)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    group = _classes([t for _, t, *_ in docs])
    docs = [min((r for r, g in zip(docs, group, strict=True) if g == k), key=_order) for k in sorted(set(group))]
    docs = [r for r in docs if not _hit(r[1], _items(bench))]
    want = brute([(i, t, lang, s) for i, t, lang, s, _ in docs], corpus_pipeline.FRACTION, corpus_pipeline.EPOCHS)
    assert sorted(((r.doc_id, r.text) for r in out), key=_order) == sorted(((i, t) for i, t, *_ in want.elements()), key=_order)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    assert len(shards) == corpus_pipeline.SHARDS and all(sorted(r.slot for r in b) == list(range(len(b))) for b in shards.values())
    sizes = [sum(r["size"] for r in b) for b in shards.values()]
    assert max(sizes) - min(sizes) < 2 * max(r["size"] for r in out)
