"""WARC archives: write captures, read records, assemble transactions.

A capture is three records: a request, a response (or a revisit, where the same
payload is kept under another capture) and metadata. Request and metadata name
the capture's response in WARC-Concurrent-To.

``write`` has Spark's text writer lay down one record for each row, with the blank
lines that end a record as its line end; so archives land in any store that Spark
writes to, and a lost task is repeated whole. ``read`` takes archives of a bounded
size as binary files and walks the records by their Content-Length, so a payload
may hold anything, other records included. ``assemble`` joins the records of a
transaction and gives one nested row for each capture.

Equal payloads of at least ``MIN_REVISIT`` bytes are kept once: the largest page_id
is the response, the others revisit it. Payloads are compared by their SHA-1,
counted before the shuffle, so a payload that a third of all pages share is one
row of a summary.

Defined results: a null html is an empty payload; a null url is an empty target;
rows that repeat page_id and payload are responses each; a null page_id is written
as empty and read as null; an empty table gives an empty result; further columns
are ignored; a request or metadata record without its response is left out, a
response without either has nulls there.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm.common import saved
from burstlake.scale import fresh_dir

CRLF = "\r\n"
MIN_REVISIT = 1000
#: Bytes that an archive has on average; a file is read by one task.
ARCHIVE_BYTES = 16_000_000
#: Shared payloads that may be broadcast, after counting; beyond that the join shuffles.
BROADCAST_ROWS = 250_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts) -> F.Column:
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _record(kind: str, key, target, block, *more) -> F.Column:
    """A record without the two line ends that close it. ``more`` are further header lines."""
    return _lines("WARC/1.1", CRLF, f"WARC-Type: {kind}", CRLF, "WARC-Record-ID: <urn:capture:", key, f":{kind}>", CRLF,
                  f"WARC-Date: {DATE}", CRLF, "WARC-Target-URI: ", target, CRLF, *more,
                  "Content-Length: ", F.octet_length(block).cast("string"), CRLF, CRLF, block)


def captures(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with payload, its SHA-1, and which page a revisit refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
                        html.alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    shared = saved(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "first"))
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def records(found: DataFrame) -> DataFrame:
    """Three record texts for each capture, as one column ``value``."""
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.substring("digest", 1, 16))
    size = F.octet_length("payload").cast("string")
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    concurrent = _lines("WARC-Concurrent-To: <urn:capture:", key, ":", kind, ">", CRLF)
    http = _lines("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", size, CRLF, CRLF)
    url = F.col("url")
    sha = _lines("WARC-Payload-Digest: sha1:", F.col("digest"), CRLF)
    body = F.when(revisit, _record("revisit", key, url, http, sha, f"WARC-Profile: {REVISIT_PROFILE}", CRLF,
                                   "WARC-Refers-To: <urn:capture:", F.col("refers_to").cast("string"), ":",
                                   F.substring("digest", 1, 16), ":response>", CRLF,
                                   "Content-Type: application/http; msgtype=response", CRLF))
    body = body.otherwise(_record("response", key, url, _lines(http, F.col("payload")), sha,
                                  "Content-Type: application/http; msgtype=response", CRLF))
    get = _lines("GET ", url, " HTTP/1.1", CRLF, "Accept: */*", CRLF, CRLF)
    request = _record("request", key, url, get, concurrent, "Content-Type: application/http; msgtype=request", CRLF)
    about = _lines("pageId: ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), CRLF, "payloadBytes: ", size, CRLF)
    meta = _record("metadata", key, url, about, concurrent, "Content-Type: application/warc-fields", CRLF)
    return found.select(F.explode(F.array(request, body, meta)).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages, compressed, each with the records of as many pages as have ``ARCHIVE_BYTES`` on average."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 1500)).first()[0] or 1500
    each = 3 * max(1, int(ARCHIVE_BYTES // size))
    (records(captures(pages)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", each).text(path))


RECORD = ("kind string, record_id string, concurrent_to string, refers_to string, target string, digest string, "
          "block_bytes long, payload_bytes long, payload_sha1 string, fields map<string,string>, block binary")


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + 4


def parse(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    """A row of ``RECORD``; of a revisit's payload only the size that its HTTP head states is known."""
    kind = headers["warc-type"]
    size, sha, fields = None, None, {}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split(CRLF)[1:])}
        size = len(payload) if kind == "response" else int(fields["content-length"])
        sha = hashlib.sha1(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].partition(":")[2]
    elif kind == "metadata":
        fields = {k: v for k, _, v in (x.partition(": ") for x in block.decode().split(CRLF) if x)}
    bare = {k: (headers.get(k) or "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")}
    return (kind, bare["warc-record-id"], bare["warc-concurrent-to"], bare["warc-refers-to"], headers.get("warc-target-uri"),
            (headers.get("warc-payload-digest") or "").partition(":")[2] or None, len(block), size, sha, list(fields.items()),
            block if keep else None)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of all archives in a folder; without ``blocks`` their contents stay behind."""
    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column(0):
                rows, size = [], 0
                for headers, block in walk(gzip.decompress(data.as_py())):
                    rows.append(parse(headers, block, blocks))
                    size += len(block)
                    if len(rows) >= 4096 or size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(each, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each response or revisit, with its request and metadata records.

    Where several requests or metadata records name the same response, the one with
    the smallest record id is taken, before anything is joined.
    """
    cols = [c for c in found.columns if c != "concurrent_to"]

    def side(kind: str) -> DataFrame:
        own = found.where(F.col("kind") == kind).groupBy("concurrent_to").agg(
            F.min_by(F.struct(*cols), F.col("record_id")).alias("x"))
        return own.select(F.col("concurrent_to").alias(f"{kind}_of"), F.col("x").alias(kind))

    main = found.where(F.col("kind").isin("response", "revisit")).select("record_id", F.struct(*cols).alias("response"))
    request, metadata = side("request"), side("metadata")
    return (main.join(request, main.record_id == request.request_of, "left")
            .join(metadata, main.record_id == metadata.metadata_of, "left")
            .select(F.col("record_id").alias("capture_id"), "request", "response", "metadata"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive record for each page, read the archives, and say what was kept of every page."""
    path = fresh_dir(pages.sparkSession, "warc")
    write(pages, path)
    rows = assemble(read(pages.sparkSession, path, blocks=False))
    page = F.nullif(F.col("metadata.fields")["pageId"], F.lit(""))
    return rows.select(
        page.cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_sha1").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.split("response.refers_to", ":")[2].cast("long").alias("refers_to"))


SQL = f"""
with p as (
  select page_id, coalesce(html, '') as payload from pages
), sized as (
  select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p
), firsts as (
  select *, case when payload_bytes >= {MIN_REVISIT} then max(page_id) over (partition by payload_digest) end as first from sized
)
select page_id, payload_bytes, payload_digest,
       case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to
from firsts"""
