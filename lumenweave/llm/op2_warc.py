"""WARC transaction assembly: archives are written, read back and joined to one nested row per capture.

Each capture writes three WARC/1.1 records: a response (or a revisit, for a payload of at least ``MIN_REVISIT`` bytes
that another capture with a larger page_id has as well), its request and its metadata; the last two name the first in
WARC-Concurrent-To. Records go out through Spark's text writer with the record end, two CRLFs, as line separator,
so a part file is a gzipped WARC file and any file system that Spark writes will do. They come back as binary
files, parsed by Content-Length, and requests and metadata join their response by WARC-Concurrent-To.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, small_batches, written

MIN_REVISIT = 1000
RECORDS_PER_FILE, FILE_BYTES = 6000, 128 << 20
BROADCAST_ROWS = 200_000  # of about 150 bytes
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _one_line(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ")


def _record(kind: str | Column, headers: dict[str, Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def first_copies(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """(rid, first) of the rows that are revisits: their record's id, and (page_id, id) of the response that holds their payload. And the bytes of the largest payload, at least ``min_revisit``.

    Only identifiers, digests and lengths are shuffled, never a payload; rows of one payload meet by partial aggregation and a join on the digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", _uuid(F.lit("response"), F.col("capture_key")).alias("rid"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("sha1")).where(F.col("n") >= min_revisit)
    p, _ = written(p, "digests")
    # the winner's two parts fit fixed-width buffers only one after the other; a null page_id never wins against an id
    copies = p.groupBy("sha1", "n").agg(F.max("page_id").alias("page_id"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "n", "page_id")
    among = p.join(copies.withColumnRenamed("page_id", "best"), ["sha1", "n"])
    ids = among.where(F.col("page_id").eqNullSafe(F.col("best"))).groupBy("sha1", "n").agg(F.max("rid").alias("best_id"))
    others = among.join(ids, ["sha1", "n"]).where("rid <> best_id")
    out, _ = written(others.select("rid", F.struct(F.col("best").alias("page_id"), F.col("best_id").alias("id")).alias("first")), "revisits")
    return out, max(min_revisit, p.agg(F.max("n")).first()[0] or 0)


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """One column ``value``: the text of each WARC record, three for every row of pages(page_id, url, html, capture_key). And the bytes of the largest payload."""
    revisits, largest = first_copies(pages, min_revisit)
    p = pages.select("page_id", "url", "capture_key", _uuid(F.lit("response"), F.col("capture_key")).alias("rid"), F.coalesce("html", F.lit("")).alias("html"))
    # beyond the bound the rows are dealt by their own identifier, evenly however popular a payload is
    p = p.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits, "rid", "left")
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    other = F.col("first").isNotNull()
    uri, digest = _one_line(F.col("url")), F.concat(F.lit("sha1:"), F.col("sha1"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    answer = _record(
        F.when(other, F.lit("revisit")).otherwise(F.lit("response")),
        {"WARC-Record-ID": F.col("rid"), "WARC-Date": F.lit(DATE), "WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "WARC-Profile": F.when(other, F.lit(REVISIT_PROFILE)), "WARC-Refers-To": F.when(other, F.col("first.id")), "WARC-Refers-To-Page": F.when(other, F.col("first.page_id").cast("string")), "Content-Type": F.lit("application/http;msgtype=response")},
        F.concat(http, F.when(other, F.lit("")).otherwise(F.col("html"))),
    )
    common = {"WARC-Date": F.lit(DATE), "WARC-Target-URI": uri, "WARC-Concurrent-To": F.col("rid")}
    request = _record("request", {"WARC-Record-ID": _uuid(F.lit("request"), F.col("capture_key")), **common, "Content-Type": F.lit("application/http;msgtype=request")}, F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")))
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-length: "), F.col("n").cast("string")), F.concat(F.lit("url-is-null: "), F.col("url").isNull().cast("string")))
    meta = _record("metadata", {"WARC-Record-ID": _uuid(F.lit("metadata"), F.col("capture_key")), **common, "Content-Type": F.lit("application/warc-fields")}, fields)
    return p.select(F.explode(F.array(answer, request, meta)).alias("value")), largest


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files of at most ``per_file`` records each, and so few that their payloads stay within ``file_bytes`` (or one capture is a file)."""
    rows, largest = records(pages, min_revisit)
    # one record of three has a payload
    most = max(3, min(per_file, 3 * (file_bytes // largest)))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def parse(stream: BinaryIO):
    """(headers with lower-case names, block) of each record of a WARC file, one record in memory at a time."""
    number = 0
    while line := stream.readline():
        number += 1
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"record {number} does not begin as a WARC record")
        h = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").removesuffix("\r\n").partition(": ")
            h[k.lower()] = v
        block = stream.read(int(h["content-length"]))
        if len(block) != int(h["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} does not end after its Content-Length")
        yield h, block


_FIELDS = [("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("refers_to_page", pa.int64()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.string())]


def _read(payloads: bool):
    schema = pa.schema([*_FIELDS, *([("payload", pa.binary())] if payloads else [])])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                size = 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    kind, payload = h["warc-type"], b""
                    body = block.split(b"\r\n\r\n", 1)[1] if kind in ("response", "revisit") else None
                    x = {"kind": kind, "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"), "declared_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                    if "warc-refers-to-page" in h:
                        x["refers_to_page"] = int(h["warc-refers-to-page"])
                    if kind == "response":
                        payload = body
                        x |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()}
                        if x["payload_digest"] != x["declared_digest"]:
                            raise ValueError(f"payload of {x['record_id']} differs from its digest")
                    elif kind == "metadata":
                        x["fields"] = block.decode()
                    if payloads:
                        x["payload"] = payload
                    out.append(x)
                    size += len(x.get("payload", b""))
                    if len(out) >= 500 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    ddl = "kind string, record_id string, concurrent_to string, target_uri string, refers_to_page bigint, declared_digest string, payload_bytes bigint, payload_digest string, fields string"
    return rows, ddl + (", payload binary" if payloads else "")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per WARC record under ``path``; a response's digest and length are computed from the bytes read and checked."""
    rows, ddl = _read(payloads)
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ddl)


def captures(recs: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, response, request, metadata structs, joined through concurrent-to identifiers."""
    whole = F.struct(*[c for c in recs.columns if c != "fields"])
    main = recs.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("id"), whole.alias("response"))
    side = recs.where(F.col("concurrent_to").isNotNull())
    few = ["record_id", "target_uri"]
    req = side.where("kind = 'request'").select(F.col("concurrent_to").alias("id"), F.struct(*few).alias("request"))
    field = lambda k: F.nullif(F.regexp_extract("fields", rf"(?:^|\n){k}: ([^\r\n]*)", 1), F.lit(""))
    meta = side.where("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", field("page-id").cast("long").alias("page_id"), field("payload-length").cast("long").alias("payload_length"), (field("url-is-null") == "true").alias("url_is_null")).alias("metadata"))
    out = main.join(req, "id", "left").join(meta, "id", "left")
    return out.select(F.col("metadata.page_id").alias("page_id"), "response", "request", "metadata")


def warc_round_trip(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, payloads: bool = True) -> DataFrame:
    """Writes pages(page_id, url, html) as archives under ``path`` and returns the captures read back from there.

    Null html counts as an empty payload, a null url as an empty address, and a null page_id comes back null. Repeated
    rows are captures of their own; rows that tie for the largest page_id are told apart by ``capture_key``, so exactly one of
    equal payloads is the response. ``capture_key`` must be unique and stable; without one, an id is numbered per partition.
    An empty table gives no captures. Extra columns are ignored.
    """
    if "capture_key" not in pages.columns:
        pages = pages.withColumn("capture_key", F.monotonically_increasing_id())
    write_archives(pages, path, min_revisit)
    return captures(read_archives(pages.sparkSession, path, payloads))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    pages = pages.select("page_id", "url", "html", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("capture_key"))
    c = warc_round_trip(pages, new_path(spark, "warc"), payloads=False)
    return c.select("page_id", F.col("metadata.payload_length").alias("payload_bytes"), F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to_page").alias("refers_to"))


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
     d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
     m as (select *, max(page_id) over (partition by payload_digest) as best, count(*) over (partition by payload_digest) as c from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> best then best end as refers_to
from m
"""
