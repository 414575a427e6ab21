"""WARC archives: written through Spark's text writer, read back with segments reassembled and chunks decoded."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.storage import new_folder
from .common import durable, table

#: Bytes of a record's block before it is continued in another record, and of a chunk of the transfer framing.
SEGMENT, CHUNK = 16 << 10, 4 << 10
#: Records of a file; with SEGMENT, this bounds a file at 64 MB.
FILE_RECORDS = 4096
LEAST_REVISIT = 0
#: Payloads of several pages whose first pages are sent to the executors, some 200 bytes each; more are joined by shuffle.
BROADCAST_SHARED = 100_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        to = body.index(b"\r\n", at)
        n = int(body[at:to].split(b";")[0], 16)
        at = to + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(body[at : at + n])
        at += n + 2


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(repr, parts)))}>"


def record(kind: str, rid: str, block: bytes, **more) -> bytes:
    """A record without its end, which is the writer's line separator."""
    heads = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in heads.items()), "\r\n"]).encode() + block


def page_records(page_id, url: str | None, payload: bytes, digest: str, first_id, first_url: str | None, segment: int, copy: int = 0):
    """The records of a page: a revisit of the first page of equal payload, or a response in as many segments as needed.

    Further copies of a page (``copy`` from 1) have record ids of their own.
    """
    key = ("page", page_id, url, digest, *(["copy", copy] if copy else []))
    own = {"WARC_Target_URI": url and url.replace("\r", "").replace("\n", ""), "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_Id": page_id}
    rid = record_id(*key)
    if (page_id, url) != (first_id, first_url):
        yield record("revisit", rid, b"", **own, WARC_Refers_To=record_id("page", first_id, first_url, digest), WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record("response", rid, block, **own)
        return
    yield record("response", rid, parts[0], **own, WARC_Segment_Number=1)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield record("continuation", record_id(*key, k), part, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def write_archive(pages: DataFrame, path: str, *, segment: int = SEGMENT, least_revisit: int = LEAST_REVISIT) -> None:
    """Write a record per page (with continuations) as gzipped WARC files under ``path``.

    Of pages of equal payload of ``least_revisit`` bytes or more, that of the smallest (page_id, url) is the response.
    Rows that agree in id, url and payload are copies of a page: all are responses or all are revisits, each with record
    ids of its own. A null html is an empty payload; a null id comes after all others; a payload of any length goes over as
    many segments as it needs; an empty table gives an archive without records.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("_d", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("by"), "url")
    copies = rows.groupBy("_d", "page_id", "url").agg(F.count("*").alias("n"))
    shared = copies.groupBy("_d").agg(F.min(order).alias("_f"), F.max(F.col("n") > 1).alias("again"), F.sum("n").alias("pages")).filter("pages > 1")
    shared = durable(shared.select("_d", F.col("_f.page_id").alias("first_id"), F.col("_f.url").alias("first_url"), "again"), "shared")
    # A payload of one page needs no partner and doesn't move; nor do the others while the first pages of all can be sent.
    found = F.broadcast(shared) if shared.count() <= BROADCAST_SHARED else shared
    rows = rows.join(found, "_d", "left").withColumn("several", F.col("again").isNotNull())
    columns = ["page_id", "url", "payload", "first_id", "first_url", "several", "copy"]
    each = rows.filter("again is null or not again").withColumn("copy", F.lit(0)).select(*columns)
    if not shared.filter("again").isEmpty():  # only payloads that have copies of a page are grouped to number them
        same = rows.filter("again").groupBy("_d", "page_id", "url", "first_id", "first_url", "several").agg(F.first("payload").alias("payload"), F.count("*").cast("int").alias("n"))
        each = each.unionByName(same.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*columns))

    def run(batches):
        for batch in batches:
            for page_id, url, payload, first_id, first_url, several, copy in zip(*[batch.column(c) for c in columns], strict=True):
                data = payload.as_py()
                own = (page_id.as_py(), url.as_py())
                first = own if len(data) < least_revisit or not several.as_py() else (first_id.as_py(), first_url.as_py())
                out = list(page_records(*own, data, payload_digest(data), *first, segment, copy.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = each.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """(headers in lower case, block) of each record of a file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        to = data.index(b"\r\n\r\n", at)
        heads = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:to].decode().split("\r\n")[1:])}
        n = int(heads["content-length"])
        if len(data) < to + 4 + n:
            raise ValueError("a record is cut off")
        yield heads, data[to + 4 : to + 4 + n]
        at = to + 4 + n


WHOLE = "page_id long, record_id string, payload_bytes long, payload_digest string, refers_to_record string"


def _number(x):
    return int(x) if x is not None else None


def _finished(heads: dict, block: bytes) -> tuple:
    payload = decoded(block)
    digest = payload_digest(payload)
    if f"sha1:{digest}" != heads["warc-payload-digest"]:
        raise ValueError(f"the payload of {heads['warc-record-id']} has another digest")
    return _number(heads.get("x-page-id")), heads["warc-record-id"], len(payload), digest, None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Whole records are decoded where they are read. Only pieces of segmented records are shuffled: they are grouped by
    origin, put in order of segment number, and checked for gaps and for the total length. Revisits take the length and
    digest from the record that they refer to. A broken record fails the job. The archives are read once: what the pass
    finds is a table of records without payloads, and of the pieces with theirs.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    names = [x.split()[0] for x in WHOLE.split(", ")]

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    piece = (pa.int32(), pa.int64(), pa.binary())

    def parsed(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for heads, block in parse_records(gzip.decompress(data.as_py())):
                    page, rid, digest = _number(heads.get("x-page-id")), heads["warc-record-id"], heads.get("warc-payload-digest", "").removeprefix("sha1:")
                    if heads["warc-type"] == "revisit":
                        rows.append((page, rid, None, digest, heads["warc-refers-to"], None, None, None))
                    elif "warc-segment-number" in heads:
                        rows.append((page, heads.get("warc-segment-origin-id", rid), None, digest, None, int(heads["warc-segment-number"]), _number(heads.get("warc-segment-total-length")), block))
                    else:
                        rows.append((*_finished(heads, block), None, None, None))
                cols = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (*types, *piece), strict=True)], names=[*names, "number", "total", "block"])

    def joined(batches):
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column("record_id").to_pylist(), batch.column("parts"), strict=True):
                parts = sorted(parts.as_py(), key=lambda x: x["number"])
                block = b"".join([x["block"] for x in parts])
                if [x["number"] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {origin} are missing")
                rows.append(_finished({"warc-record-id": origin, "x-page-id": parts[0]["page_id"], "warc-payload-digest": f"sha1:{parts[0]['payload_digest']}"}, block))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    found = durable(files.mapInArrow(parsed, f"{WHOLE}, number int, total long, block binary"), "records")
    records = found.filter("number is null").select(*names)
    cut = found.filter("number is not null").groupBy("record_id").agg(F.collect_list(F.struct("number", "total", "page_id", "payload_digest", "block")).alias("parts"))
    whole = durable(cut.mapInArrow(joined, WHOLE), "reassembled")  # read twice
    responses = records.filter(F.col("refers_to_record").isNull()).unionByName(whole)
    revisits = records.filter(F.col("refers_to_record").isNotNull())
    target = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_n")).dropDuplicates(["refers_to_record"])
    again = revisits.join(target, "refers_to_record")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    done = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return done.unionByName(again.select("page_id", F.col("_n").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to").select(columns))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
bits AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
five AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)) AS q FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[CAST(i // 4 AS BIGINT) + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM five
"""
