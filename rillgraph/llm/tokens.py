"""Token-ID files: patched frame-of-reference blocks."""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.llm import blobs
from rillgraph.llm.common import cut, fresh_dir, table

NAME = "op5_tokens"
MAGIC = b"PFOR1\0\0\0"
BLOCK, PERCENTILE = 128, 90
FILE_IDS = 8 << 20
#: Text bytes that a range of ids is to hold; there are at least as many ranges as the session's shuffle partitions.
PART_BYTES = 64 << 20
#: Pieces whose ids a worker remembers (about 70 bytes each); beyond, it forgets all and begins anew (memory only).
MEMORY = 2_000_000
#: Characters that are encoded at once, and rows of a batch; where long texts may be cut.
CHARS, ROWS, CUT = 1 << 18, 512, re.compile(r"\w ")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(bytes, start of each block) of uint32 ids, in blocks of BLOCK.

    A block is: minimum (u4), width (u1), exceptions (u1), values (u2); then the low `width` bits of each value less the
    minimum, packed; then the exceptions' positions (u1) and their high bits (u4). width is what the given percentile of the
    block's values needs. All blocks of one width are packed at once.
    """
    n, most = len(ids), 4096 * BLOCK
    if not n:
        return b"", np.empty(0, np.uint64)
    if n > most:  # bounded memory
        parts, out, at = [pack_blocks(ids[i : i + most], percentile) for i in range(0, n, most)], [], 0
        for b, s in parts:
            out.append(s + np.uint64(at))
            at += len(b)
        return b"".join(b for b, _ in parts), np.concatenate(out)
    nb = -(-n // BLOCK)
    full = np.full(nb * BLOCK, 0, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    full = full.reshape(nb, BLOCK)
    low = full.min(axis=1)
    off = full - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    rank = np.partition(off, at, axis=1)[:, at].astype(np.uint64)
    width = np.where(rank > 0, np.floor(np.log2(np.maximum(rank, 1))) + 1, 0).astype(np.uint8)
    over = (off.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    count = np.full(nb, BLOCK, np.uint16)
    count[-1] = n - (nb - 1) * BLOCK
    ex_r, ex_c = np.nonzero(over)
    n_ex = np.bincount(ex_r, minlength=nb)
    size = 8 + BLOCK // 8 * width.astype(np.int64) + 5 * n_ex
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.empty((nb, 8), np.uint8)
    head[:, :4], head[:, 4], head[:, 5], head[:, 6:] = low.astype("<u4")[:, None].view(np.uint8), width, n_ex, count.astype("<u2")[:, None].view(np.uint8)
    out[starts[:, None] + np.arange(8)] = head
    for w in np.unique(width).tolist():
        if w:
            rows = np.nonzero(width == w)[0]
            kind = "<u2" if w <= 16 else "<u4"
            bits = np.unpackbits(off[rows].astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
            out[starts[rows][:, None] + 8 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    if len(ex_r):
        base = starts + 8 + BLOCK // 8 * width.astype(np.int64)
        nth = np.arange(len(ex_r)) - np.repeat(np.cumsum(n_ex) - n_ex, n_ex)
        out[base[ex_r] + nth] = ex_c
        out[(base[ex_r] + n_ex[ex_r] + 4 * nth)[:, None] + np.arange(4)] = over[ex_r, ex_c].astype("<u4")[:, None].view(np.uint8)
    return out.tobytes(), starts.astype(np.uint64)


def unpack_block(buf, at: int) -> np.ndarray:
    """The ids of the block that begins there."""
    low, width, n_ex, count = struct.unpack_from("<IBBH", buf, at)
    at += 8
    if width:
        bits = np.unpackbits(np.frombuffer(buf, np.uint8, BLOCK * width // 8, at), bitorder="little").reshape(BLOCK, width)
        v = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        at += BLOCK * width // 8
    else:
        v = np.zeros(BLOCK, np.uint32)
    if n_ex:
        v[np.frombuffer(buf, np.uint8, n_ex, at)] |= np.frombuffer(buf, "<u4", n_ex, at + n_ex) << np.uint32(width)
    return v[:count] + np.uint32(low)


def unpack_all(buf, starts: np.ndarray) -> np.ndarray:
    """All blocks at once, grouped by width."""
    if not len(starts):
        return np.empty(0, np.uint32)
    if len(starts) > 4096:  # bounded memory
        return np.concatenate([unpack_all(buf, starts[i : i + 4096]) for i in range(0, len(starts), 4096)])
    b = np.frombuffer(buf, np.uint8)
    s = starts.astype(np.int64)
    head = b[s[:, None] + np.arange(8)]
    low, width, n_ex, count = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 5].astype(np.int64), head[:, 6:8].copy().view("<u2")[:, 0]
    out = np.zeros((len(s), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            raw = b[s[rows][:, None] + 8 + np.arange(BLOCK * w // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            v = np.zeros((len(rows), BLOCK), np.uint32)
            for i in range(w):
                v |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
            out[rows] = v
    ex = np.repeat(np.arange(len(s)), n_ex)
    if len(ex):
        base = s + 8 + BLOCK * width // 8
        nth = np.arange(len(ex)) - np.repeat(np.cumsum(n_ex) - n_ex, n_ex)
        hi = b[(base[ex] + n_ex[ex] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[ex, b[base[ex] + nth]] |= hi << width[ex].astype(np.uint32)
    out += low[:, None]
    keep = np.arange(BLOCK) < count[:, None]
    return out[keep]


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """MAGIC, blocks, document ids (JSON), document lengths (u8), block starts (u8), then the footer: three sizes (u8) and MAGIC."""
    body, starts = pack_blocks(ids)
    docs = json.dumps(doc_ids).encode()
    return MAGIC + body + docs + lengths.astype("<u8").tobytes() + (starts + len(MAGIC)).astype("<u8").tobytes() + struct.pack("<QQQ", len(starts), len(doc_ids), len(docs)) + MAGIC


def decode_index(buf: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, block starts) of a file."""
    if buf[:8] != MAGIC or buf[-8:] != MAGIC:
        raise ValueError("no token file")
    nb, nd, nj = struct.unpack_from("<QQQ", buf, len(buf) - 32)
    at = len(buf) - 32 - 8 * nb
    return json.loads(buf[at - 8 * nd - nj : at - 8 * nd]), np.frombuffer(buf, "<u8", nd, at - 8 * nd), np.frombuffer(buf, "<u8", nb, at)


def byte_letters() -> dict[int, int]:
    """For str.translate() of Latin-1 decoded bytes: the letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by the properties that the published pattern names."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            out[m.start() : m.end()] = kind
    return out


def piece_starts(c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a piece begins, in code points c of classes kind whose texts are parted by (and end with) EDGE; a piece of
    EDGE is none. Equal to the published pattern: contractions, then runs of letters, numbers or other characters with a
    space before them if there is one, then spaces without the one before a run.
    """
    n = len(c)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    full = kind < SPACE
    start[1:] &= ~(full[1:] & (c[:-1] == 32))  # the run takes the space before it
    start[:-1] |= (kind[:-1] == SPACE) & full[1:]
    at = np.nonzero((c == 39) & start)[0]
    at = at[(at + 3 < n)]
    at = at[kind[at + 1] == LETTER]
    if len(at):
        x, y = c[at + 1], c[at + 2]
        one = np.isin(x, [ord(l) for l in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
    return start


class Encoder:
    """Token ids of whole texts by the tokenizers library.

    The library's own pre-tokenizer parts a text into pieces and merges inside a piece only. Here pieces are found for many
    texts at once, each different piece is encoded by the library's model once, and a text's ids are its pieces' ids joined.
    Pieces are told apart by a 64-bit hash: of n different ones two share it with a chance of about n^2 / 2^65. Texts with a
    special token's string go to the library whole.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tok.model, byte_letters()
        self.up = self.down = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slots = 1 << 16
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.flat, self.used, self.first, self.size, self.n = np.empty(1 << 16, np.uint32), 0, np.zeros(1 << 15, np.uint32), np.zeros(1 << 15, np.int32), 0

    def _powers(self, n: int) -> None:
        while len(self.up) < n:  # doubling keeps this cheap
            base, inverse = self.BASE, pow(self.BASE, -1, 1 << 64)
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, m, 1 << 64))])

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's entry; -1 where it is unknown."""
        at = self._place(h)
        got = self.keys[at]
        out = np.where(got == h, self.entry[at], -1)
        left = np.nonzero((got != h) & (got != 0))[0]
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            got = self.keys[at[left]]
            out[left] = np.where(got == h[left], self.entry[at[left]], -1)
            left = left[(got != h[left]) & (got != 0)]
        return out

    def _insert(self, h: int, k: int) -> None:
        at = ((h * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)) >> (64 - self.slots.bit_length() + 1)
        while self.keys[at]:
            at = (at + 1) & (self.slots - 1)
        self.keys[at], self.entry[at] = h, k

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if 2 * (self.n + len(pieces)) > self.slots:
            old = self.keys[at := np.nonzero(self.keys)[0]], self.entry[at]
            while 2 * (self.n + len(pieces)) > self.slots:
                self.slots *= 2
            self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
            for x, k in zip(*(o.tolist() for o in old), strict=True):
                self._insert(x, k)
        for x, p in zip(hashes.tolist(), pieces, strict=True):
            v = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
            k, self.n = self.n, self.n + 1
            if k >= len(self.first):
                self.first, self.size = (np.concatenate([y, np.zeros_like(y)]) for y in (self.first, self.size))
            while self.used + len(v) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.first[k], self.size[k] = self.used, len(v)
            self.flat[self.used : self.used + len(v)] = v
            self.used += len(v)
            self._insert(x, k)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0\0"
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = classes()[c]
        kind[ends] = kind[-1] = EDGE
        at = np.nonzero(piece_starts(c, kind))[0]
        stop = np.append(at[1:], len(c))
        real = kind[at] != EDGE
        at, stop = at[real], stop[real]
        self._powers(len(c) + 1)
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.up[: len(c)], out=sums[1:])
        h = ((sums[stop] - sums[at]) * self.down[at]) ^ ((stop - at).astype(np.uint64) << np.uint64(40))
        h = np.maximum(h, np.uint64(1))
        if self.n > MEMORY:
            self._forget()
        k = self._find(h)
        if (k < 0).any():
            new = np.nonzero(k < 0)[0]
            hashes, which = np.unique(h[new], return_index=True)
            which = new[which]
            self._learn(hashes, [joined[x:y] for x, y in zip(at[which].tolist(), stop[which].tolist(), strict=True)])
            k[new] = self._find(h[new])
        size = self.size[k]
        after = np.cumsum(size, dtype=np.int64)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.first[k].astype(np.int64) - (after - size), size) + np.arange(total)]
        upto = np.concatenate([[0], after])[np.searchsorted(at, ends)]
        return ids, np.diff(upto, prepend=0)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(texts)
        parts, held = [], 0  # (text number, part of it)

        def flush() -> None:
            ids, lengths = self._encode([p for _, p in parts])
            raw, x = memoryview(ids.astype("<u4", copy=False).tobytes()), 0
            for (i, _), n in zip(parts, lengths.tolist(), strict=True):
                out[i] += raw[x : x + 4 * n]
                x += 4 * n
            parts.clear()

        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for p in halves(t):
                parts.append((i, p))
                held += len(p) + 1
                if held >= CHARS:
                    flush()
                    held = 0
        if parts:
            flush()
        return out


def halves(text: str) -> Iterator[str]:
    """Parts of a long text. It is cut before a space after a word character, where a piece begins whatever follows."""
    at = 0
    while len(text) - at > 2 * CHARS and (m := CUT.search(text, at + CHARS)):
        yield text[at : m.end() - 1]
        at = m.end() - 1
    yield text[at:] if at else text


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: tasks share the pieces that it knows."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files in ascending id order (null ids first); returns the manifest
    (part, seq, file, docs, ids), whose order by (part, seq) is the order of the ids.

    Documents are range-partitioned by (id, hash), into ranges of about PART_BYTES of text, and sorted inside each partition,
    so a file holds a run of the order (of equal ids by a hash of the text). Null texts are empty
    and still end with `end_id`; repeated rows are encoded again; an empty table gives no file. Other columns are not read. A file is closed
    at `file_ids` ids, which bounds a task's memory; a longer single text has a file of its own.
    """
    spark = docs.sparkSession
    folder = blobs.make_dir(folder or fresh_dir(spark, "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, names, runs, held = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            w = blobs.Writer(folder, f"part-{part:06d}-{seq:04d}", ".pfor")
            w.write(encode_file(names, np.array([len(r) // 4 for r in runs], np.uint64), np.frombuffer(b"".join(runs), "<u4")))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [w.close()], "docs": [len(names)], "ids": [held]})

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part_ = b.slice(at, ROWS)
                for name, r in zip(part_.column(0).to_pylist(), enc([t or "" for t in part_.column(1).to_pylist()]), strict=True):
                    names.append(name)
                    runs.append(r + end)
                    held += len(r) // 4 + 1
                    if held >= file_ids:
                        yield flush()
                        seq, names, runs, held = seq + 1, [], [], 0
        if names:
            yield flush()

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    held = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))
    d = d.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "t")
    return cut(d.mapInArrow(run, "part long, seq long, file string, docs long, ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file): for each document of the files, from the bytes in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                buf = blobs.read(uri)
                names, sizes, starts = decode_index(buf)
                raw = memoryview(unpack_all(buf, starts).astype("<u4").tobytes())
                ends = np.cumsum(sizes.astype(np.int64))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + ends - sizes.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([uri] * len(names))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    # a row for each file: the running sum over them is small, however large the corpus
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return m.select("file", "base").repartition(min(4096, max(1, manifest.count()))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json"))).drop("file")
