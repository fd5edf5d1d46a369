"""Deleted interpolation: bigram language-model scores of whole texts."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import blobs
from rillgraph.llm.common import cut, discard, fresh_dir, table

NAME = "op9_lm"
#: Tokens of a block (its few MB of arrays are what a task holds) and of a key range.
BLOCK_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS = 1 << 19, 1 << 20, 64
#: Local word numbers and hashes of the two marks; real words follow.
BOS, END, MARKS = 0, 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: EM starts on cells (context bucket, quantised log2 p2, quantised log2 p1), at most 64 x 161 x 161, on the driver; it ends on the
#: probabilities themselves, in so many rounds at most or when no weight moves by more than TOLERANCE.
STEP, CELLS, ROUNDS, TOLERANCE = 4, 160, 12, 1e-4
DEFAULT = (0.6, 0.3, 0.1)
_Z, _D = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(x: np.ndarray) -> bytes:
    """Compressed bytes by significance: most counts are small, so high planes are nearly empty."""
    return _Z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unplanes(b: bytes, kind: type) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_D.decompress(b), np.uint8).reshape(w, -1).T).view(kind).reshape(-1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one file: the sizes of their planes, then those."""
    parts = [planes(a) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(raw: bytes, kinds: list[type]) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(unplanes(raw[at : at + n], kind))
        at += n
    return out


def deltas(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def _mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs from 64-bit keys of words."""
    x = u * np.uint64(0xD6E8FEB86659FD93) + ((w << np.uint64(31)) | (w >> np.uint64(33)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so keys in order are in order of their buckets too."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Block:
    """Tokens of a run of documents: word numbers in order of appearance, and each word's 64-bit key."""

    KINDS = (np.int64, np.uint8, np.uint8, np.int64, np.uint64, np.uint32)  # ids, have one, rest, tokens, word keys, tokens

    def __init__(self, file: str):
        self.ids, self.known, self.rest, self.n, self.words, self.toks = unpack(blobs.read(file), list(self.KINDS))
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        before = np.empty_like(self.toks)
        before[1:] = self.toks[:-1]
        before[np.cumsum(self.n) - self.n] = BOS
        pairs = (before.astype(np.uint64) << np.uint64(32)) | self.toks
        types, pair = np.unique(pairs, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del pairs, pair, before
        self.u, self.w = (types >> np.uint64(32)).astype(np.int32), (types & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.ukeys, self.uat = np.unique(self.words, return_inverse=True)
        self.bkeys, bat = np.unique(_mix(self.words[self.u], self.words[self.w]), return_inverse=True)
        self.bat = bat.astype(np.int32)

    def counts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unigram and bigram key, in the documents so marked."""
        on = docs[self.doc]
        c = np.bincount(self.toks[on], minlength=len(self.words))
        c[BOS] = docs.sum()
        b = np.bincount(self.pair[on], minlength=len(self.u))
        return (np.bincount(at, c2, n).astype(np.uint32) for at, c2, n in ((self.uat, c, len(self.ukeys)), (self.bat, b, len(self.bkeys))))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as files of about BLOCK_TOKENS tokens: (block, file, tokens). A text is never split."""
    folder = blobs.make_dir(fresh_dir(docs.sparkSession, "blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def begin() -> dict[bytes, int]:
            return defaultdict(count(2).__next__)

        def flush() -> pa.RecordBatch:
            keys = np.array([*MARKS, *(xxhash.xxh64_intdigest(w, 0) for w in words)], np.uint64)
            w = blobs.Writer(folder, f"{(part << 32) + seq}", ".block")
            known = np.array([i is not None for i in ids], np.uint8)
            w.write(pack([np.array([i or 0 for i in ids], np.int64), known, np.array(rest, np.uint8), np.array([len(t) for t in toks], np.int64), keys, np.concatenate(toks)]))
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + seq], "file": [w.close()], "tokens": [held]})

        words, ids, rest, toks, held = begin(), [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                t = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                a = np.empty(len(t) + 1, np.uint32)
                a[:-1] = np.fromiter(map(words.__getitem__, t), np.uint32, len(t))
                a[-1] = END
                ids.append(b.column(0)[i].as_py())
                rest.append(b.column(2)[i].as_py())
                toks.append(a)
                held += len(a)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    seq, words, ids, rest, toks, held = seq + 1, begin(), [], [], [], 0
        if ids:
            yield flush()

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10, F.lit(1)).cast("int").alias("rest"))
    return d.mapInArrow(run, "block long, file string, tokens long")


def each(fn):
    """fn of each (block number, file); what it holds is let go before the next, so a task has one block in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield fn(block, file)

    return run


def _answers(folder: str, block: int) -> list[np.ndarray]:
    """[unigram train, fold, bigram train, fold] counts in the whole corpus of a block's keys, in their order."""
    return unpack(blobs.read(f"{folder}/{block}.counts"), [np.uint32] * 4)


def _sound(w: np.ndarray, bucket: int) -> np.ndarray:
    """Weights that sum to 1 and give no text probability 0; a context without count has no bigrams."""
    w = np.maximum(w, [0.0 if bucket == 0 else 1e-6, 1e-6, 1e-6])
    return w / w.sum()


def starting_weights(cells: list[tuple[int, int, int, int, int]], rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation on held-out cells
    (bucket, q2, q1, q0, tokens); probabilities are 2^(-q / STEP), q = CELLS stands for 0."""
    out = np.tile(np.array(DEFAULT), (64, 1))
    out[0] = (0, DEFAULT[1] / (1 - DEFAULT[0]), DEFAULT[2] / (1 - DEFAULT[0]))
    c = np.array(cells, np.float64).reshape(-1, 5)
    for b in np.unique(c[:, 0]).astype(int):
        x = c[c[:, 0] == b]
        p = np.where(x[:, 1:4] >= CELLS, 0.0, np.exp2(-x[:, 1:4] / STEP))
        w = out[b].copy()
        for _ in range(rounds):
            r = p * w
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            w = (r * x[:, 4:]).sum(axis=0) / x[:, 4].sum()
        out[b] = _sound(w, b)
    return out


def learn_weights(counts: DataFrame, total: int, types: int) -> np.ndarray:
    """Weights by EM on held-out tokens: counts holds (cu, cb, cw, n), the counts of context, bigram and word without the held-out
    documents, and how often that combination occurs. Each round is one aggregate of at most 64 rows."""
    p0 = 1 / (types + 1)
    quantised = lambda p: F.when(p > 0, F.least(F.lit(CELLS - 1), F.round(-STEP * F.log2(p)))).otherwise(CELLS).cast("int")
    c = counts.select(F.when(F.col("cu") > 0, F.floor(F.log2("cu") + 1e-12) + 1).otherwise(0).cast("int").alias("b"), (F.col("cb") / F.greatest("cu", F.lit(1))).alias("p2"), (F.col("cw") / F.lit(float(max(1, total)))).alias("p1"), "n")
    q0 = min(CELLS - 1, round(STEP * math.log2(types + 1)))
    cells = c.groupBy("b", quantised(F.col("p2")).alias("q2"), quantised(F.col("p1")).alias("q1")).agg(F.sum("n").alias("n")).collect()
    w = starting_weights([(r["b"], r["q2"], r["q1"], q0, r["n"]) for r in cells])
    for _ in range(ROUNDS):
        at = [F.element_at(F.array(*[F.lit(float(x)) for x in w[:, k]]), F.col("b") + 1) for k in range(3)]
        parts = [at[0] * F.col("p2"), at[1] * F.col("p1"), at[2] * p0]
        whole = F.col("n") / (parts[0] + parts[1] + parts[2])
        sums = c.groupBy("b").agg(*[F.sum(whole * x).alias(f"r{k}") for k, x in enumerate(parts)]).collect()
        new = w.copy()
        for r in sums:
            x = np.array([r["r0"], r["r1"], r["r2"]])
            new[r["b"]] = _sound(x / x.sum(), r["b"])
        moved, w = np.abs(new - w).max(), new
        if moved <= TOLERANCE:
            break
    return w


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Tokens are lower-cased (A-Z) words and an end mark. Training documents are those whose crc32(id) mod 10 is not 0. The
    model mixes bigram and unigram maximum-likelihood estimates and 1 / (V + 1); the weights depend on the bucket floor(log2)
    of the context's count and are learned by EM on all tokens of the training documents with remainder 1, against counts from
    which those documents are deleted; the final counts are of all training documents.

    Counting: documents become blocks (a written table); each block sends its different n-grams, as sorted 64-bit keys with
    local counts, to key ranges, where they are summed and the sums returned in the block's order. What moves is a block's
    n-gram types, not its tokens; a frequent word or a hot document is one key for each block. Blocks are then scored where
    they lie. Two n-grams share a key with a chance of about n / 2^64.

    Null texts are empty (one token, the end mark); a null id counts as remainder 1; repeated rows count each time; empty
    input gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    table_ = cut(blocks(docs, id_col, text_col), "block-manifest")
    tokens, n_blocks = table_.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not tokens:
        return spark.createDataFrame([], schema)
    buckets = max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
    spread = table_.select("block", "file").repartition(min(n_blocks, 1 << 16), "block")
    folder = blobs.make_dir(fresh_dir(spark, "counts"))

    def asked_of(block: int, file: str) -> pa.RecordBatch:
        x = Block(file)
        train, fold = x.counts(x.rest != 0), x.counts(x.rest == 1)
        (ut, bt), (uf, bf) = train, fold
        ends = [np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1)) for k in (x.ukeys, x.bkeys)]
        some = np.nonzero((np.diff(ends[0]) > 0) | (np.diff(ends[1]) > 0))[0]  # rows are at most the block's n-gram types
        cuts = lambda a, e, f=planes: [f(a[e[k] : e[k + 1]]) for k in some]
        cols = [some.astype(np.int32), np.full(len(some), block), cuts(x.ukeys, ends[0], deltas), cuts(ut, ends[0]), cuts(uf, ends[0]), cuts(x.bkeys, ends[1], deltas), cuts(bt, ends[1]), cuts(bf, ends[1])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "block", "uk", "ut", "uf", "bk", "bt", "bf"])

    def add(t: pa.Table) -> pa.Table:
        who, bucket, out, sums = t.column("block").to_numpy(), t.column("bucket")[0].as_py(), {}, [0, 0]
        order = np.argsort(who)
        for key, parts in (("uk", ("ut", "uf")), ("bk", ("bt", "bf"))):
            keys = [undeltas(t.column(key)[int(i)].as_py()) for i in order]
            ends = np.cumsum([len(k) for k in keys])
            types, at = np.unique(np.concatenate(keys), return_inverse=True)
            for p in parts:
                c = np.concatenate([unplanes(t.column(p)[int(i)].as_py(), np.uint32) for i in order])
                total = np.bincount(at, c, len(types)).astype(np.uint32)
                out[p] = [planes(x) for x in np.split(total[at], ends[:-1])]
                if p == "ut":
                    real = types != np.uint64(MARKS[BOS])
                    sums = [int((total[real] > 0).sum()), int(total[real].sum())]
        n = len(order)
        return pa.table({"block": pa.array(who[order]), "bucket": pa.array([bucket] * n, pa.int32()), **{p: pa.array(v, pa.binary()) for p, v in out.items()}, "v": pa.array([sums[0]] + [0] * (n - 1)), "n": pa.array([sums[1]] + [0] * (n - 1))})

    def keep(t: pa.Table) -> pa.Table:
        """The sums of one block, in order, as a file of its own; a second attempt replaces it by the same bytes."""
        order, block = np.argsort(t.column("bucket").to_numpy()), t.column("block")[0].as_py()
        cols = [np.concatenate([unplanes(t.column(p)[int(i)].as_py(), np.uint32) for i in order]) for p in ("ut", "uf", "bt", "bf")]
        w = blobs.Writer(folder, f"{block}", ".counts")
        w.write(pack(cols))
        blobs.rename(w.close(), f"{folder}/{block}.counts")
        return pa.table({"block": [block], "v": [sum(t.column("v").to_pylist())], "n": [sum(t.column("n").to_pylist())]})

    asked = spread.mapInArrow(each(asked_of), "bucket int, block long, uk binary, ut binary, uf binary, bk binary, bt binary, bf binary")
    summed = asked.groupBy("bucket").applyInArrow(add, "block long, bucket int, ut binary, uf binary, bt binary, bf binary, v long, n long")
    kept = cut(summed.groupBy("block").applyInArrow(keep, "block long, v long, n long"), "answered")
    types, total = kept.agg(F.sum("v"), F.sum("n")).first()

    def held_out_counts(block: int, file: str) -> pa.RecordBatch:
        x = Block(file)
        ut, uf, bt, bf = _answers(folder, block)
        on = np.bincount(x.pair[(x.rest == 1)[x.doc]], minlength=len(x.u))
        k = np.nonzero(on)[0]
        u, b = (ut - uf)[x.uat].astype(np.int64), (bt - bf)[x.bat].astype(np.int64)
        c = np.stack([u[x.u[k]], b[k], u[x.w[k]]], axis=1)
        kinds, at = np.unique(c, axis=0, return_inverse=True) if len(c) else (c, k)
        n = np.bincount(at.reshape(-1), on[k], len(kinds)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*[pa.array(kinds[:, i]) for i in range(3)], pa.array(n)], names=["cu", "cb", "cw", "n"])

    held = spread.mapInArrow(each(held_out_counts), "cu long, cb long, cw long, n long").groupBy("cu", "cb", "cw").agg(F.sum("n").alias("n"))
    held = cut(held, "held-out")
    weights = learn_weights(held, total, types)
    discard(held, kept)

    def scored(block: int, file: str) -> pa.RecordBatch:
        x = Block(file)
        ut, _, bt, _ = _answers(folder, block)
        u, b = ut[x.uat].astype(np.float64), bt[x.bat].astype(np.float64)
        w = weights[np.floor(np.log2(np.maximum(u[x.u], 0.5))).astype(np.int64) + 1]
        p = w[:, 0] * b / np.maximum(u[x.u], 1) + w[:, 1] * u[x.w] / total + w[:, 2] / (types + 1)
        n = len(x.n)
        of = lambda v: np.bincount(x.doc, v, n)
        base = np.log10((u + 0.1) / (total + 0.1 * (types + 1)))
        cols = [pa.array(x.ids, mask=x.known == 0), pa.array(x.rest == 0), pa.array(x.n), pa.array(of((u > 0)[x.toks]).astype(np.int64)), pa.array(np.full(n, total)), pa.array(of(base[x.toks])), pa.array(of(np.log10(p)[x.pair]))]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return spread.mapInArrow(each(scored), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
