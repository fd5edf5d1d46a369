"""Empty tables, nulls, long texts, ties, repeated rows and clashing columns, for operators whose own tests leave them out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rillgraph.llm import chat, decontaminate, neardup, warc


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "one two three " * 40_000), (2, None), (2, None), (None, "a b c d e f g h i j k"), (3, "A B c d e f g h i j")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b c d e f g h i j"), ("w", "a b c d e f g h i j"), (None, "two three one"), ("n", None)], "item_id string, text string")
    got = decontaminate.contamination(clash(docs, "id", "w", "tok", "win", "pos", "items", "rank", "_text_md5"), clash(bench, "item", "w", "win")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items))
    assert by == {1: [(120_000, 119_997, 0)], 2: [(0, 0, 0)] * 2, None: [(11, 10, 2)], 3: [(10, 10, 2)]}
    want = hashlib.sha256(b"w,x").hexdigest()
    assert {r.items_sha256 for r in got if r.doc_id == 3} == {want}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_conversations_edges(spark):
    schema = "tree string, msg long, parent long, role string, text string, score double"
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0
    long = "x<|im_end|>" * 20_000
    rows = [("t", 1, None, None, None, None), ("t", 2, 1, "assistant", long, 1.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "a", 1.0)]
    got = chat.conversations(clash(spark.createDataFrame(rows, schema), "leaf", "rank", "up", "n", "sum", "depth", "head", "piece"), 2).orderBy("rank").collect()
    assert [(r.leaf, r.rank) for r in got] == [(2, 1), (3, 2)]  # equal scores: by leaf
    turns = spark.createDataFrame(got).select(chat.parse(F.col("formatted")).alias("t")).collect()
    assert [[tuple(x) for x in r.t] for r in turns] == [[("", ""), ("assistant", long)], [("", ""), ("assistant", "a")]]


def test_archives_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc.read(warc.write(spark.createDataFrame([], schema))).count() == 0
    big = "é<p>" * 300_000
    rows = [(1, "u v\n", big), (2, None, big), (2, None, big), (None, "n", big), (3, "", "\r\n\r\n" * 40), (4, "u", "\r\n\r\n" * 40), (5, "u", "z" * 99), (6, "u", "z" * 99)]
    got = warc.read(warc.write(clash(spark.createDataFrame(rows, schema), "id", "digest", "first", "refers_to", "k", "s"), archive_bytes=1000)).collect()
    found = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    n = len(big.encode())
    assert found == sorted([("1", "response", None, n), ("2", "revisit", 1, n), ("2", "revisit", 1, n), ("None", "response", None, n), ("3", "response", None, 160), ("4", "revisit", 3, 160), ("5", "response", None, 99), ("6", "response", None, 99)])
    assert {r.payload_digest for r in got if r.page_id == 1} == {hashlib.sha256(big.encode()).hexdigest()}


def test_archives_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    rows = [(i, "u", f"{i % 7}" * 200) for i in range(50)]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert all((r.record_type, r.refers_to) == (("response", None) if r.page_id < 7 else ("revisit", r.page_id % 7)) for r in got) and len(got) == 50


def test_cut_off_archive(tmp_path):
    import zstandard

    frame = zstandard.ZstdCompressor(write_content_size=True).compress(warc.record("response", 1, "u", b"x" * 500))
    assert len(list(warc.read_archive(frame * 3))) == 3
    for bad in (frame[:-3], frame + b"\0\0\0\0", frame + frame[:9]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


def test_near_copies_refuse_their_own_names(spark):
    with pytest.raises(ValueError):
        neardup.groups(clash(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "_node"))
