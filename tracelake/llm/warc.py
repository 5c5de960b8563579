"""WARC archives: writing, reading and transaction assembly (operator 1)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, written

EOL = "\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100
#: Records of an archive at most; a reader takes an archive whole.
FILE_RECORDS = 60_000
#: Payload bytes of the record batches that a reader yields.
YIELD_BYTES = 4 << 20
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, fields map<string,string>"


def _id(*parts: Column) -> Column:
    """A record id that repeats for equal parts."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _record(kind: str | Column, record_id: Column, date: str, block: Column, content_type: str, fields: dict[str, Column]) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]  # null: no line
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit("")]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL), block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a request, a response or revisit, and a metadata record for each page, as gzipped WARC files under `path`.

    Of the pages with equal payloads of REVISIT_BYTES or more, that with the smallest page id is written as a response,
    and the others as revisits that refer to it; shorter payloads are always responses. Only the digests that occur
    more than once are joined to the pages, so a page that many share makes no hot task beyond what a skewed join splits.
    Spark's text writer concatenates the records (each ends with two line ends), so its commits hold for archives too.

    A null payload is empty. Null urls and page ids leave their fields out. Repeated rows are written repeatedly, with
    equal record ids. Control characters and spaces in a url are percent-encoded. An empty table writes no record.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))
    shared = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    shared = written(shared.select(F.col("digest").alias("d"), "first"), "shared")
    rows = rows.join(shared, F.col("digest") == F.col("d"), "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    own = _id(F.lit("capture"), F.col("page"), F.col("digest"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL + EOL))
    host = F.regexp_extract(uri, r"^[A-Za-z]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace(uri, r"^[A-Za-z]+://[^/?#]*", ""), F.lit("/")), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(EOL + EOL))
    fields = F.concat_ws(EOL, F.concat(F.lit("page-id: "), F.col("page").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string")), F.lit(""))
    records = rows.select(F.explode(F.array(
        _record("request", _id(F.lit("request"), F.col("page"), F.col("digest")), date, get, "application/http;msgtype=request", {"WARC-Target-URI": uri, "WARC-Concurrent-To": own}),
        _record(F.when(is_revisit, "revisit").otherwise("response"), own, date, F.when(is_revisit, http).otherwise(F.concat(http, F.col("html"))), "application/http;msgtype=response", {
            "WARC-Target-URI": uri, "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "WARC-Refers-To": F.when(is_revisit, _id(F.lit("capture"), F.col("first"), F.col("digest"))),
        }),
        _record("metadata", _id(F.lit("metadata"), F.col("page"), F.col("digest")), date, fields, "application/warc-fields", {"WARC-Target-URI": uri, "WARC-Concurrent-To": own}),
    )).alias("value"))
    records.write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, piece by piece; gzip in one member or one for each record."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(rest, 1 << 20)
            rest = member.unconsumed_tail
            if not piece and not rest and not member.eof:
                raise ValueError("the archive ends inside a record")
            yield piece
        rest = member.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive; it holds one record at a time."""
    pieces, held, at = _inflated(data), bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        held, at = held[at:] + piece, 0
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends inside a record")
                return
        head = held[at:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size, at = int(fields.get("content-length", 0)), end + 4
        while len(held) - at < size + 4 and more():
            pass
        if len(held) - at < size:
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[at : at + size])
        at += size + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under `path` (RECORD, and the payload unless it isn't wanted).

    Archives come through Spark's binary reader, so any store works; one archive must fit a task's memory compressed,
    and one record inflated. The payload of an HTTP record is its body; its digest is computed from the body, for a
    revisit it is the one that the header tells. Damaged archives fail the read.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), *([("payload", pa.binary())] if with_payload else [])])

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for content in batch.column("content"):
            for head, block in parse(content.as_py()):
                kind, body, extra = head.get("warc-type"), block, []
                if head.get("content-type", "").startswith("application/http"):
                    body = block.partition(b"\r\n\r\n")[2]
                elif head.get("content-type") == "application/warc-fields":
                    extra = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s]
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                if kind == "response":
                    digest = hashlib.sha256(body).hexdigest()
                rows.append((head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, len(body), extra, *([body] if with_payload else [])))
                held += len(body) if with_payload else 200
                if held >= YIELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for b in batches:
            yield from each(b)

    return files.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, and the requests and metadata whose concurrent-to names it.

    Records meet under one identifier, that of the capture; a single exchange brings them together. Requests and
    metadata without a capture give a row with a null `capture`; a capture without them has empty lists. A response that
    was written repeatedly gives a row each time; repeated requests and metadata are listed once.
    """
    capture = F.col("type").isin("response", "revisit")
    names = [f.name for f in records.schema.fields if f.name != "fields"]
    whole = F.struct(*names, F.array_sort(F.map_entries("fields")).alias("entries"))
    keyed = records.select(F.when(capture, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id"), "type", whole.alias("r"))
    met = keyed.groupBy("capture_id").agg(
        F.collect_list(F.when(capture, F.col("r"))).alias("captures"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "request", F.col("r")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", F.col("r")))).alias("metadata"),
    )
    return met.select("capture_id", F.explode_outer("captures").alias("capture"), "requests", "metadata")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture in the archives, revisits resolved."""
    slim = assemble(read_archives(spark, path, with_payload=False)).filter("capture IS NOT NULL")
    field = lambda name: F.expr(f"get(filter(flatten(transform(metadata, m -> m.entries)), e -> e.key = '{name}'), 0).value")
    slim = slim.select("capture_id", field("page-id").cast("long").alias("page_id"), "capture.type", "capture.refers_to", "capture.payload_bytes", "capture.payload_digest")
    slim = written(slim, "captures")
    firsts = written(slim.filter("type = 'response'").groupBy(F.col("capture_id").alias("first_id")).agg(F.min("page_id").alias("first_page"), F.max("payload_bytes").alias("first_bytes")), "firsts")
    out = slim.join(firsts, F.col("refers_to") == F.col("first_id"), "left")
    is_revisit = F.col("type") == "revisit"
    return out.select("page_id", F.when(is_revisit, F.col("first_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.when(is_revisit, F.col("first_page")).alias("refers_to"))
