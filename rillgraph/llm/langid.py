"""Language identification: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.columns import private
from rillgraph.llm.common import table

NAME = "op1_langid"
#: The model is fitted on a seeded sample of at most SAMPLE labelled documents, whole, with at most SAMPLE_CHARS characters in
#: all. Languages share both evenly, but each may have LEAST documents.
SAMPLE, SAMPLE_CHARS, LEAST = 1600, 2_400_000, 20
SPAN, EPOCHS, RATE, DECAY, SEED = 64, 6, 0.15, 1e-5, 11
#: Hash bits of features, longest n-gram, and words in a label's lexicon (its most frequent ones in the sample).
BITS, GRAMS, LEXICON = 17, 5, 400
#: Words whose emissions a worker remembers (memory only).
MEMORY = 400_000
UNKNOWN = "und"


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Features:
    """Indices of hashed features of words: n-grams inside the word, affixes (n-grams at its edges), the whole word."""

    @staticmethod
    def of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat indices, number for each word) of words of letters."""
        text = "".join(f"\x02{w}\x03" for w in words)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first, last = np.nonzero(c == 2)[0], np.nonzero(c == 3)[0]
        word = np.repeat(np.arange(len(words)), last - first + 1)
        found, owner = [], []
        h = np.zeros(len(c), np.uint64)
        for n in range(1, GRAMS + 1):
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            inside = word[: len(h)] == word[n - 1 :]
            k = np.nonzero(inside & (c[: len(h)] > 2) if n == 1 else inside)[0]
            found.append(h[k])
            owner.append(word[k])
        size = np.bincount(owner := np.concatenate(owner), minlength=len(words))
        h = np.concatenate(found)[np.argsort(owner, kind="stable")]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - BITS)).astype(np.int64), size


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(word posteriors, expected transitions, log partition) of sequences in falling length; the last two if `pairs`.

    e: scores (T, B, K); trans: transition scores (K, K). Each step is scaled, so no length over- or underflows.
    """
    T, B, K = e.shape
    top = e.max(axis=2, keepdims=True)
    x = np.exp(e - top)
    move = np.exp(trans)
    live = np.searchsorted(-lengths, -np.arange(T), side="left")  # sequences longer than t
    a, scale = np.zeros_like(x), 0.0
    for t in range(T):
        n = live[t]
        v = x[t, :n] if t == 0 else (a[t - 1, :n] @ move) * x[t, :n]
        s = v.sum(axis=1, keepdims=True)
        a[t, :n] = v / s
        if pairs:
            scale += float(np.log(s).sum() + top[t, :n].sum())
    after = None  # emissions of the next step: x takes the posteriors
    b = np.zeros((B, K), x.dtype)
    total = np.zeros((K, K)) if pairs else None
    for t in range(T - 1, -1, -1):
        n, later = live[t], live[t + 1] if t + 1 < T else 0
        b[later:n] = 1
        if later:
            y = after[:later] * b[:later]
            if pairs:
                joint = a[t, :later, :, None] * move[None] * y[:, None, :]
                total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            y = y @ move.T
            b[:later] = y / y.sum(axis=1, keepdims=True)
        g = a[t, :n] * b[:n]
        after = x[t].copy()
        x[t, :n] = g / g.sum(axis=1, keepdims=True)
        x[t, n:] = 0
    return x, total, scale


class Model:
    """Labels, emission weights of hashed features, weights of the labels' lexicons, and transition scores."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.w, self.trans = labels, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
        self.lexicon: dict[str, int] = {}
        self.lex = np.zeros((k, k), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ok = [i for i, w in enumerate(part) if w]
            if ok:
                idx, size = Features.of([part[i] for i in ok])
                rows = np.add.reduceat(self.w[idx], np.cumsum(size) - size, axis=0)
                for j, i in enumerate(ok):
                    k = self.lexicon.get(part[i])
                    if k is not None:
                        rows[j] += self.lex[k]
                out[at + np.array(ok)] = rows
        return out


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model | None:
    """A model of (text, label) rows by AdaGrad on the conditional likelihood; None without labels.

    Texts are used whole, in spans of SPAN words at most; every word has its document's label. Every other training sequence
    joins halves of two spans, so that the transitions learn switches inside a text.
    """
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    m, rng, k = Model(labels), np.random.default_rng(seed), len(labels)
    docs = []
    for text, y in rows:
        toks = [w for w in map(letters, text.lower().split()) if w]
        docs += [(toks[i : i + SPAN], labels.index(y)) for i in range(0, len(toks), SPAN)]
    if not docs:
        return m
    seen = [Counter() for _ in labels]
    for toks, y in docs:
        seen[y].update(toks)
    best: dict[str, tuple[int, int]] = {}
    for y, c in enumerate(seen):  # a word is in the lexicon of the label that has most of it
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            best[w] = max(best.get(w, (0, 0)), (n, y))
    m.lexicon = {w: y for w, (_, y) in best.items()}
    names = sorted({w for toks, _ in docs for w in toks})
    number = {w: i for i, w in enumerate(names)}
    idx, size = Features.of(names)
    at = np.concatenate([[0], np.cumsum(size)])
    in_lex = np.array([m.lexicon.get(w, -1) for w in names])
    gw, gl, gt = np.full(m.w.shape, 1e-6, np.float32), np.full(m.lex.shape, 1e-6), np.full(m.trans.shape, 1e-6)
    for _ in range(EPOCHS):
        order, seqs = rng.permutation(len(docs)), []
        for n, i in enumerate(order):
            toks, y = docs[i]
            if n % 2 and n + 1 < len(order):
                toks2, y2 = docs[order[n - 1]]
                seqs.append(([*toks[: SPAN // 2], *toks2[: SPAN // 2]], [y] * len(toks[: SPAN // 2]) + [y2] * len(toks2[: SPAN // 2])))
            else:
                seqs.append((toks, [y] * len(toks)))
        for i in range(0, len(seqs), 128):
            batch = sorted(seqs[i : i + 128], key=lambda s: -len(s[0]))
            lengths, tmax = np.array([len(s[0]) for s in batch]), len(batch[0][0])
            ids, gold = np.full((tmax, len(batch)), -1), np.zeros((tmax, len(batch)), np.int64)
            for j, (toks, ys) in enumerate(batch):
                ids[: len(toks), j], gold[: len(toks), j] = [number[w] for w in toks], ys
            on = ids >= 0
            types, inv = np.unique(ids[on], return_inverse=True)
            take = np.concatenate([np.arange(at[w], at[w + 1]) for w in types])
            feats, n_feats = idx[take], size[types]
            em = np.add.reduceat(m.w[feats], np.cumsum(n_feats) - n_feats, axis=0)
            lx = in_lex[types]
            em[lx >= 0] += m.lex[lx[lx >= 0]]
            e = np.zeros((*ids.shape, k))
            e[on] = em[inv]
            post, moves, _ = forward_backward(e, lengths, m.trans, pairs=True)
            d = -post[on]
            d[np.arange(len(d)), gold[on]] += 1
            dw = np.zeros((len(types), k))
            np.add.at(dw, inv, d)
            seen_moves = np.zeros((k, k))
            both = on[1:] & on[:-1]
            np.add.at(seen_moves, (gold[:-1][both], gold[1:][both]), 1)
            scale = 1 / len(batch)
            g = np.zeros_like(m.w)
            rep = np.repeat(np.arange(len(types)), n_feats)
            for y in range(k):
                g[:, y] = np.bincount(feats, dw[rep, y], len(g)) * scale
            used = np.unique(feats)
            g = g[used] - DECAY * m.w[used]
            gw[used] += g * g
            m.w[used] += RATE * g / np.sqrt(gw[used])
            dl = np.zeros_like(m.lex)
            np.add.at(dl, lx[lx >= 0], dw[lx >= 0] * scale)
            gl += dl * dl
            m.lex += (RATE * dl / np.sqrt(gl)).astype(np.float32)
            dt = (seen_moves - moves) * scale
            gt += dt * dt
            m.trans += RATE * dt / np.sqrt(gt)
    return m


class Tagger:
    """Word posteriors of whole texts; keeps the emissions of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.e, self.real = np.zeros((1 << 12, len(self.model.labels)), np.float32), np.zeros(1 << 12, bool)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MEMORY:
            self._forget()
        known, first = self.known, len(self.known)
        out = []
        for t in texts:
            toks = t.lower().split()
            try:
                a = np.fromiter(map(known.__getitem__, toks), np.int64, len(toks))
            except KeyError:
                for w in toks:
                    if w not in known:
                        known[w] = len(known)
                a = np.fromiter(map(known.__getitem__, toks), np.int64, len(toks))
            out.append(a)
        if len(known) > first:
            from itertools import islice

            new = list(map(letters, islice(known, first, None)))
            while len(known) > len(self.e):
                self.e, self.real = np.concatenate([self.e, np.zeros_like(self.e)]), np.concatenate([self.real, np.zeros_like(self.real)])
            self.e[first : len(known)] = self.model.emissions(new)
            self.real[first : len(known)] = [bool(w) for w in new]
        return out

    def __call__(self, texts: list[str], words: bool = False) -> list[tuple[int, float, np.ndarray | None]]:
        """For each text (label number or -1, share of its posterior mass, word posteriors if asked for)."""
        ids = self.numbers(texts)
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        out: list = [(-1, 0.0, None)] * len(ids)
        trans = self.model.trans.astype(np.float32)
        at = 0
        while at < len(order) and len(ids[order[at]]):
            tmax = len(ids[order[at]])
            n = max(1, min(len(order) - at, 300_000 // tmax))
            group = [i for i in order[at : at + n] if len(ids[i])]
            at += n
            lengths = np.array([len(ids[i]) for i in group])
            grid = np.zeros((tmax, len(group)), np.int64)
            for j, i in enumerate(group):
                grid[: lengths[j], j] = ids[i]
            post, _, _ = forward_backward(self.e[grid], lengths, trans)
            mass = (post * self.real[grid][:, :, None]).sum(axis=0, dtype=np.float64)
            for j, i in enumerate(group):
                if mass[j].sum() > 0:
                    y = int(mass[j].argmax())
                    out[i] = (y, min(1.0, float(mass[j, y] / mass[j].sum())), post[: lengths[j], j] if words else None)
        return out


_TAGGER: list = [None, None]


def identify(docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text", words: bool = False) -> DataFrame:
    """`columns` of docs with lang_pred and score, and with `word_langs` (the label of each white-space token) if asked for.

    lang_pred is the label with most posterior mass over the text's words (tokens with a letter), score its share (of equal
    labels the first by name); `und` and 0 where the text is null or has no letter, or no label was learned. Every text is
    read whole, in batches bounded by Arrow. Rows that repeat stay and get equal answers; an empty table gives no rows.
    `columns` may not hold lang_pred, score or word_langs (ValueError); any other name, `_text` too, is free.
    """
    if {c.lower() for c in columns} & {"lang_pred", "score", "word_langs"}:
        raise ValueError("columns that are made here can't be carried along")
    text = private(docs, "text")[0]
    d = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias(text))
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^BITS features and LEXICON words a label
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != text), "lang_pred string, score double", *["word_langs array<string>"] * words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        if _TAGGER[0] is not m:  # tasks of a worker share it
            _TAGGER[:] = [m, Tagger(m) if m else None]
        tag, names = _TAGGER[1], [*m.labels, UNKNOWN] if m else [UNKNOWN]
        for b in batches:
            rows: list = []
            for at in range(0, b.num_rows, 2000):
                texts = [t or "" for t in b.column(text).slice(at, 2000).to_pylist()]
                rows += tag(texts, words) if tag else [(-1, 0.0, None)] * len(texts)
            cols = [b.column(c) for c in columns] + [pa.array([names[y] for y, _, _ in rows], pa.string()), pa.array([s for _, s, _ in rows], pa.float64())]
            if words:
                cols.append(pa.array([None if p is None else [names[y] for y in p.argmax(axis=1)] for _, _, p in rows], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "lang_pred", "score", *["word_langs"] * words])

    return d.mapInArrow(run, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of a bounded sample of the documents whose crc32(id) mod 3 is not 1 and whose text and language are known, the
    same on each run; None if there are none.

    Each language's documents are drawn by a seeded hash below a bound that follows from its count, so tasks send a few
    numbers of about the sample's size, and no rare language is left out. The texts of those chosen come in a second scan.
    Repeated rows count once.
    """
    k = F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))
    d = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r["y"]: r["n"] for r in d.groupBy(F.col(lang_col).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    quota = max(LEAST, sample // len(sizes))
    bound = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, (quota + 4 * quota**0.5) / n))])
    small = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 52)) / float(1 << 52) <= F.element_at(bound, F.col(lang_col))
    drawn = d.where(small).groupBy(F.col(lang_col).alias("y"), k.alias("k")).agg(F.max(F.char_length(text_col)).alias("c")).collect()
    chosen: list[int] = []
    for y in sorted(sizes):
        room, mine = chars // len(sizes), 0
        for r in sorted((r for r in drawn if r["y"] == y), key=lambda r: r["k"]):
            if mine < quota and r["c"] <= room:
                room, mine = room - r["c"], mine + 1
                chosen.append(r["k"])
    rows = d.where(small & k.isin(chosen)).groupBy(F.col(lang_col).alias("y"), k.alias("k")).agg(F.min(text_col).alias("t")).collect() if chosen else []
    return train([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["k"], r["y"]))])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, fit(docs), ["doc_id", "held_out"])
