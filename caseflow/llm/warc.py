"""WARC archives of web pages: a deterministic sharded writer and a reader.

Pages are cut into ranges of page_id by exact size histograms, each range is sorted and written by one task, and a file is closed once its compressed
size passes a limit. Records are gzip members of their own. Headers, lengths and digests are made anew; of pages with
equal payloads one is a response and the others are revisit records that refer to it. A file gets its name by a
rename when it is complete, and counts once its row is in the manifest table, so repeated tasks change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table
from .sharding import SharedFile, by_shard, open_shared, range_cuts, with_shard

#: Uncompressed bytes of pages in a shard, about, and compressed bytes after which a file is closed.
SHARD_BYTES = 1 << 23
FILE_BYTES = 1 << 24
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id, digest: str, ordinal: int) -> str:
    """The id of the ordinal-th record of a page id with a payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}:{ordinal}')}>"


def _header_value(url: str | None, page_id) -> str:
    """A target URI without white space or control characters."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def warc_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, ordinal: int = 0, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit has the HTTP header alone."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, ordinal)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url, page_id)}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, the same for the same data."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Inflated(io.RawIOBase):
    """Concatenated gzip members as one stream of bytes."""

    def __init__(self, raw):
        self.raw, self.d, self.rest = raw, None, b""

    def readable(self):
        return True

    def readinto(self, target):
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 16)
                if not self.rest:
                    return 0
            self.d = self.d or zlib.decompressobj(31)
            out = self.d.decompress(self.rest, len(target))
            if self.d.eof:
                self.rest, self.d = self.d.unused_data, None
            else:
                self.rest = self.d.unconsumed_tail
            if out:
                target[: len(out)] = out
                return len(out)


def read_records(raw):
    """(headers with lower-case names, block bytes) of every record of a compressed archive."""
    f = io.BufferedReader(_Inflated(raw), 1 << 16)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.strip().lower()] = value.strip()
        block = f.read(int(head["content-length"]))
        if f.read(4) != b"\r\n\r\n" or len(block) != int(head["content-length"]):
            raise ValueError("a record is cut off")
        yield head, block


_MANIFEST = "shard int, name string, records long, bytes long, first_page long, last_page long"


def write_warc(ws: Workspace, pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_revisit: int = 0) -> tuple[DataFrame, str, int]:
    """Write all pages (page_id, url, html) to ``folder``; returns (manifest table: one row a file, folder, number of shards).

    The response among rows of equal payloads of at least ``min_revisit`` bytes is that with the smallest page_id (null is larger than
    all); of rows that share this page_id too, the first written. Null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    small = ws.save(pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size")), "digests")
    groups = small.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    groups = ws.save(groups, "groups")
    refers = small.join(groups, "digest").select("page_id", "digest", "refers_to").distinct()
    cuts = range_cuts(small.withColumn("size", F.col("size") + 500), "page_id", "size", shard_bytes)
    text = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", html.alias("html"))
    marks = refers.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = with_shard(text.unionByName(marks).withColumn("th", F.xxhash64("digest")), "page_id", "th", cuts).select("th", "shard", "page_id", "digest", "kind", "refers_to", "url", "html")

    def run(batches):
        shard, out, name, seq, stats = None, None, None, 0, None
        group, refers_to, marked, ordinal = None, None, False, 0

        def close():
            size = out.commit()
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([stats[0]]), pa.array([size]), pa.array([stats[1]], pa.int64()), pa.array([stats[2]], pa.int64())], names=["shard", "name", "records", "bytes", "first_page", "last_page"])

        for b in batches:
            for i in range(b.num_rows):
                s, page_id, digest, kind = (b.column(k)[i].as_py() for k in range(1, 5))
                if s != shard:
                    if out:
                        yield close()
                    shard, out, seq = s, None, 0
                if (page_id, digest) != group:
                    group, marked, refers_to, ordinal = (page_id, digest), False, None, 0
                if kind == 0:
                    marked, refers_to = True, b.column(5)[i].as_py()
                    continue
                if out is None:
                    name = f"pages-{shard:06d}-{seq:04d}.warc.gz"
                    out, stats, seq = SharedFile(folder, name), [0, page_id, page_id], seq + 1
                revisit = marked and (ordinal > 0 or refers_to != page_id)
                payload = b.column(7)[i].as_py().encode("utf-8", "surrogatepass")
                out.write(gzip_member(warc_record(page_id, b.column(6)[i].as_py(), payload, refers_to, revisit, ordinal)))
                ordinal += 1
                stats[0], stats[2] = stats[0] + 1, page_id
                if out.size >= file_bytes:
                    yield close()
                    out = None
        if out:
            yield close()

    parts = by_shard(rows, cuts.shards, "page_id", "th", "digest", "kind", "url")
    return ws.save(parts.mapInArrow(run, _MANIFEST), "manifest").dropDuplicates(["name"]), folder, cuts.shards


def read_warc(manifest: DataFrame, folder: str, tasks: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the manifest's files.

    The files of a shard are read by one of ``tasks`` tasks. A response's digest is computed from its payload and must equal its header; a revisit's length and digest are those that its headers state.
    """

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                out = [[] for _ in range(5)]
                with open_shared(folder, name) as f:
                    for head, block in read_records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: a payload does not match its headers")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        for c, v in zip(out, (page and int(page), size, digest, kind, refers and int(refers)), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # an explicit number of partitions: names are small, and adaptive execution would put them all into one
    files = manifest.select("name", "shard").repartitionById(tasks, F.col("shard"))
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(spark: SparkSession, pages: DataFrame, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of all pages and read them back: a row for every page row.

    Null html and null urls are empty payloads and a urn of the page; null or repeated page ids are kept as they are (see ``write_warc``).
    Empty tables give no rows; columns other than page_id, url and html are not read.
    """
    ws = Workspace(spark, "warc")
    folder = f"{ws.root}/archives"
    return read_warc(*write_warc(ws, pages, folder, shard_bytes, file_bytes))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
""",
}
