"""Operator 5, WARC: archives written by Spark's text sink, and transactions assembled from what is read back.

A capture is three records: request, response (or revisit) and metadata, the first and the last
pointing to the second by WARC-Concurrent-To. A record's text is a row and the blank lines that end a
record are the sink's line separator, so the files come from Spark's own committed writers.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, text_or_empty

END = "\r\n\r\n"
#: Payloads of so many bytes and more are stored once.
REVISIT_BYTES = 100
#: Up to so many digests with several pages (some 50 MB) are sent to every task; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
DATE = "2026-01-01T00:00:00Z"


def _urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    pieces = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: str | Column, id_: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text up to the blank lines after it; fields whose value is null are left out."""
    head = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), id_), F.lit(f"WARC-Date: {DATE}")]
    head += [F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", "")) for name, value in fields]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), block)


def write(pages: DataFrame, path: str, records_per_file: int = 6_000, file_bytes: int = 128 << 20) -> None:
    """Writes the captures of ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    A file holds at most ``records_per_file`` records, and so many that records of mean size fill
    ``file_bytes``; a reader unpacks it as a stream, whatever single records' sizes. A file is one
    gzip member, as Spark's sink writes it, where the standard recommends one for each record.

    Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is the
    response and the others revisit it; rows that repeat that page_id with that payload are all
    responses, and where all ids of a payload are null so are they. A null html is empty; a null
    url has no WARC-Target-URI, and line ends in a url are dropped. An empty table gives a folder
    without records. Other columns of ``pages`` don't matter, whatever their names.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    known = rows.select("page_id", "url", "bytes", "digest").filter(F.col("bytes") >= REVISIT_BYTES)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("x")
    firsts = known.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1")
    firsts = checkpointed(firsts.select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url")))
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    id_ = _urn(F.col("page_id"), F.col("digest"), F.coalesce("url", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    path_of = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*(/[^\s]*)", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/\s]*)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    target = ("WARC-Target-URI", F.col("url"))
    only = lambda value: F.when(revisit, value)
    records = F.array(
        _record("request", _urn(F.lit("request"), id_), [target, ("WARC-Concurrent-To", id_), ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(
            F.when(revisit, "revisit").otherwise("response"), id_,
            [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Refers-To", only(_urn(F.col("first"), F.col("digest"), F.col("first_url")))),
             ("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.when(revisit, http).otherwise(F.concat(http, "html")),
        ),
        _record(
            "metadata", _urn(F.lit("metadata"), id_), [target, ("WARC-Concurrent-To", id_), ("Content-Type", F.lit("application/warc-fields"))],
            F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.url_encode(F.col("page_id").cast("string"))), F.lit("via: locusflow")),
        ),
    )
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 1_500)).first()[0] or 1.0
    most = max(3, min(records_per_file, int(3 * file_bytes / mean)))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


RECORD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("http_head", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


def parse(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, one after the other by their Content-Length; only one is held at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where {line[:20]!r} stands")
        fields: dict[str, list[str]] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode(errors="replace").partition(":")
            fields.setdefault(name.lower(), []).append(value.strip())
        one = lambda name, fields=fields: fields.get(name, [None])[0]
        length = int(one("content-length") or -1)
        block = stream.read(max(0, length))
        if len(block) != length:
            raise ValueError(f"{one('warc-record-id')} is cut off or has no length")
        http, payload = "", block
        if (one("content-type") or "").startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            http = first.decode(errors="replace")
        yield {
            "type": one("warc-type"), "record_id": one("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"),
            "date": one("warc-date"), "payload_digest": one("warc-payload-digest"), "http_head": http, "payload": payload, "error": None,
        }


def read(spark: SparkSession, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of all archives under ``path``, gzipped (of any number of members) or plain.

    A file is read by one task, which holds its packed bytes and ``batch_bytes`` of records. What
    can't be read of a damaged file is one row without type whose ``error`` says why and where; the
    records before it are given. Records that repeat are given as often as they stand there.
    """
    import pyarrow as pa

    text = ("type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "http_head", "error")
    arrow = pa.schema([(f.name, pa.string() if f.name in text else pa.binary() if f.name == "payload" else pa.list_(pa.string())) for f in RECORD.fields])

    def records_of(data: bytes, name: str) -> Iterator[dict]:
        raw = io.BytesIO(data)
        try:
            yield from parse(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw)
        except (ValueError, EOFError, OSError, zlib.error) as wrong:
            yield dict.fromkeys(arrow.names) | {"error": f"{name}: {wrong}"}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for record in records_of(batch.column("content")[i].as_py(), batch.column("path")[i].as_py()):
                    held.append(record)
                    size += len(record["payload"] or b"") + 1_000
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInArrow(each, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, joined with the request and metadata concurrent to it.

    A capture without request or metadata has a null there; requests and metadata concurrent to no
    record are not captures. Captures written more than once (their rows repeat) come as often as
    they were written, ``copies`` telling how often.
    """
    body = F.struct("type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "http_head", "payload")
    heads = records.filter(F.col("type").isin("response", "revisit")).groupBy("record_id").agg(F.first(body).alias("response"), F.count("*").alias("copies"))

    def side(kind: str) -> DataFrame:
        mine = records.filter(F.col("type") == kind).select(F.explode("concurrent_to").alias("record_id"), F.struct("target_uri", "http_head", "payload").alias("x"))
        return mine.groupBy("record_id").agg(F.first("x").alias(kind))

    return heads.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def page_id_of(capture: str = "metadata", kind: str = "long") -> Column:
    """The page id that a capture's metadata record names, of the type ``kind``, or null."""
    text, field = F.col(capture)["payload"].cast("string"), r"(?m)^page-id: (\S*)\r?$"
    return F.when(F.regexp_like(text, F.lit(field)), F.url_decode(F.regexp_extract(text, field, 1)).try_cast(kind))


def captures(assembled: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture, a revisit's payload being its response's.

    ``id_type`` is the type of the ids: ``string`` takes any text there was; ids that aren't of it are null.
    """
    own = checkpointed(assembled.select(
        "record_id", page_id_of(kind=id_type).alias("page_id"), F.octet_length(F.col("response.payload")).cast("long").alias("bytes"), F.sha2(F.col("response.payload"), 256).alias("sha"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"), "copies",
    ))
    whole = own.filter(F.col("record_type") == "response").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("sha").alias("_sha"))
    both = own.join(whole, "to", "left").withColumn("_again", F.explode(F.expr("sequence(1L, copies)")))
    return both.select("page_id", F.coalesce("_bytes", "bytes").alias("payload_bytes"), F.coalesce("_sha", "sha").alias("payload_digest"), "record_type", "refers_to")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
