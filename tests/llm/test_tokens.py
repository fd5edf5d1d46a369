"""Token files: ids against the library, exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillgraph.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return np.array(Tokenizer.from_file(str(PATH)).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    signs = [*"abcdelmrstv'  \n\t12!?-_.", "'s", "'ll", "'re", "'ve", "'d", "''", "\r\n", "é", "ß", "中", "٣", " ", " ", "\x1c", "\x85", "\U0001f600", "́", "\0"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(1000)]
    return [*out, "", "a<|endoftext|>b", "x" * 500, " " * 99]


def test_ids_equal_the_library(texts):
    tok, enc = Tokenizer.from_file(str(PATH)), tokens.Encoder(PATH)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc(texts) == want
    enc._forget()
    assert enc(texts[:50]) == want[:50]


def test_long_text_in_parts(texts, monkeypatch):
    whole = library("\n".join(texts))
    monkeypatch.setattr(tokens, "CHARS", 1000)
    assert tokens.Encoder(PATH)(["\n".join(texts)])[0] == whole


@pytest.mark.parametrize("ids", [[], [5], [0, 2**32 - 1] * 200, list(range(1000)), [7] * 300, list(range(0, 2**32, 9_000_001)), [1] * 120 + [70_000] * 8])
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint32)
    buf = tokens.encode_file([1], np.array([len(a)], np.uint64), a)
    _, _, starts = tokens.decode_index(buf)
    assert (tokens.unpack_all(buf, starts) == a).all()
    assert (np.concatenate([a[:0], *[tokens.unpack_block(buf, int(s)) for s in starts]]) == a).all()
    with pytest.raises(ValueError):
        tokens.decode_index(buf[:-1])


def test_block_layout():
    ids = np.full(128, 1000, np.uint32)
    ids[:20], ids[100] = np.arange(1000, 1020), 2**31
    body, starts = tokens.pack_blocks(ids)
    low, width, n_ex = int.from_bytes(body[:4], "little"), body[4], body[5]
    assert (low, width, n_ex, list(starts)) == (1000, 4, 5, [0])  # 90 % are below 13; 16 to 19 and the outlier are exceptions
    assert len(body) == 8 + 128 * 4 // 8 + 5 * 5


def test_files(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "x1"]) for _ in range(rng.randint(1, 40))), "mine") for i in rng.sample(range(10_000), 30)]
    rows += [(None, "no id", "mine"), (20_000, None, None), (20_001, "", ""), (20_002, "same", ""), (20_002, "same", ""), (20_003, "long word " * 60_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = tokens.read(tokens.write(df, PATH, file_ids=500)).orderBy("start", "n_tokens").collect()
    assert len(got) == len(rows) and len({r.file for r in got}) > 3
    start = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = library(t) + b"\2\0\0\0"
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert tokens.read(tokens.write(df.limit(0), PATH)).count() == 0
