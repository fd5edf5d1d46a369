"""WARC archives: one Zstandard frame for each record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import blobs
from rillgraph.llm.common import cut, fresh_dir, table

NAME = "op10_warc"
#: Skippable frame that holds the dictionary; the Zstandard frame's magic number.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary is fitted on at most SAMPLE pages' first SAMPLE_CHARS characters. It is no part of any result.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 512, 4096, 32_768
ARCHIVE_BYTES, LEAST_REVISIT = 8 << 20, 100
#: Repeated digests are broadcast up to this many (about 100 bytes each).
MOST_BROADCAST = 100_000
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; b"" where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def frame_size(buf, at: int) -> int:
    """Bytes of the Zstandard frame at that place, from its header and block headers (RFC 8878, 3.1.1)."""
    if at + 6 > len(buf) or struct.unpack_from("<I", buf, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no Zstandard frame at byte {at}")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(buf):
            raise WarcError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(buf[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(buf):
        raise WarcError(f"the frame at byte {at} is cut off")
    return pos - at


def record(kind: str, page_id, url: str | None, payload: bytes, refers_to=None, digest: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries the payload's length and digest but not the payload."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, length of the full payload) of one record; raises WarcError on any header or length that is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise WarcError("no WARC/1.1 header")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(": ")
        if not colon or k in h:
            raise WarcError(f"bad header line {line[:80]!r}")
        h[k] = v
    for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"):
        if k not in h:
            raise WarcError(f"no {k}")
    if h["WARC-Type"] not in ("response", "revisit") or not h["Content-Length"].isdigit():
        raise WarcError("bad WARC-Type or Content-Length")
    n = int(h["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the frame has {len(rest) - 4}")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length: (\d+)$", http)
    if not sep or not http.startswith(b"HTTP/1.1 ") or not m:
        raise WarcError("no HTTP header")
    full = int(m[1])
    if h["WARC-Type"] == "response":
        if len(payload) != full:
            raise WarcError(f"HTTP Content-Length is {full}, the payload has {len(payload)}")
        if h["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise WarcError("the payload's digest differs")
    elif payload or "WARC-Refers-To" not in h:
        raise WarcError("a revisit with a payload or without WARC-Refers-To")
    return h, payload, full


def read_archive(buf: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """The records of one archive. The dictionary is loaded from the leading skippable frame (itself compressed or plain);
    then each frame is decoded alone and must hold exactly one valid record."""
    at, dic = 0, None
    if len(buf) >= 8 and struct.unpack_from("<I", buf)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", buf, 4)[0]
        raw = buf[8 : 8 + n]
        if len(raw) != n:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dic, at = zstandard.ZstdCompressionDict(raw), 8 + n
    d = zstandard.ZstdDecompressor(dict_data=dic)
    view = memoryview(buf)
    while at < len(buf):
        n = frame_size(buf, at)
        try:
            data = d.decompressobj().decompress(view[at : at + n])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at}: {e}") from e
        yield parse(data)
        at += n


def dedupe(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, refers_to): of equal payloads of at least `least` bytes all but the smallest id refer to it.

    A first scan sends digests only, pre-aggregated, and keeps those that occur twice (a written table). Pages meet them where
    they lie, by a broadcast of at most MOST_BROADCAST digests; beyond, both sides are shuffled, and AQE splits a payload that
    a third of all pages share. Rows with a null id never refer and are never referred to.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = cut(firsts, "repeated")
    small = F.broadcast if firsts.count() <= MOST_BROADCAST else (lambda x: x)
    return p.join(small(firsts), "digest", "left").select("id", "url", "html", "digest", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary of a seeded sample of at most SAMPLE pages: a hash below a bound that follows from their number, so tasks
    send about that many rows in all, however large the input; equal rows count once."""
    n = pages.count()
    k = F.xxhash64("page_id", "url")
    drawn = pages.where(F.pmod(k, F.lit(1 << 40)) <= int((1 << 40) * min(1.0, 2 * SAMPLE / max(1, n))))
    rows = drawn.groupBy(k.alias("k")).agg(F.min(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS)).alias("s")).orderBy("k").limit(SAMPLE).collect()
    return train([r["s"].encode("utf-8", "surrogatepass") for r in rows if r["s"]])


def write(pages: DataFrame, folder: str | None = None, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (archive, records) as a table, committed once for each task that counts.

    Null html is an empty payload, null urls are left out, null ids are empty headers; repeated rows are records of their
    own (all rows of a group's smallest id are responses); an empty table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = blobs.make_dir(folder or fresh_dir(spark, "warc"))
    ready, dic = dedupe(pages), dictionary(pages)
    packed = zstandard.ZstdCompressor(level=19).compress(dic) if dic else b""
    lead = struct.pack("<II", DICT_MAGIC, len(packed)) + packed if dic else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, n = _compressor(dic, level), None, 0
        for b in batches:
            for i in range(b.num_rows):
                page, url, html, digest, refers = (b.column(j)[i].as_py() for j in range(5))
                if out is None:
                    out, n = blobs.Writer(folder, "part", ".warc.zst"), 0
                    out.write(lead)
                out.write(z.compress(record("response" if refers is None else "revisit", page, url, html.encode("utf-8", "surrogatepass"), refers, digest)))
                n += 1
                if out.size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [out.close()], "records": [n]})
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pydict({"archive": [out.close()], "records": [n]})

    return cut(ready.mapInArrow(run, "archive string, records long"), "warc-manifest")


@functools.lru_cache(maxsize=1)
def _compressor(dic: bytes, level: int) -> zstandard.ZstdCompressor:
    """One for each Python worker: the dictionary's tables are built once."""
    if not dic:
        return zstandard.ZstdCompressor(level=level, write_content_size=True)
    held = zstandard.ZstdCompressionDict(dic)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of the manifest's
    archives; payload is null for revisits. A broken archive, or one with another number of records, raises WarcError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                for h, payload, full in read_archive(blobs.read(uri)):
                    page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                    to = int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None
                    rows.append((page, h.get("WARC-Target-URI"), full, h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], to, payload if to is None else None))
                    size, seen = size + full, seen + 1
                    if size >= 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if seen != want:
                    raise WarcError(f"{uri} has {seen} records, not {want}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 4096))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from g
"""
