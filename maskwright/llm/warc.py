"""WARC archives: writing pages as transactions and reading them back as one nested row per capture.

Writing uses Spark's text writer, so the archives (gzip) go wherever Spark can write; each page gives a
response (or revisit) record and a request and a metadata record that name it as concurrent.  Of pages
with equal payloads the one with the largest id is the response; the others are revisits of it and
carry no payload.  Reading parses whole files as streams, a record at a time, and assembles the
records of a transaction through WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The alphabet of base32 (RFC 4648) and the revisit profile of WARC 1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file at most; three make a page.
RECORDS_PER_FILE = 60_000
#: Payload bytes handed to Spark at once by a reader.
BATCH_BYTES = 4 << 20


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32: 160 bits are 8 times 20, each 5 hexadecimal digits and 4 characters."""
    hexed = F.sha1(data)
    chars = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def _record(kind: str, rid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its last line feed, which the text writer adds."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid]
    for name, value in fields:
        head += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> None:
    """Write pages as gzip WARC files below path.

    Payload: the html in UTF-8, null as empty.  Of payloads of at least least_revisit bytes that are
    equal, that with the largest id is written in full (all rows that repeat this id and payload are),
    the others as revisits; a null id is smaller than any other.  A null url becomes urn:page:<id>;
    control characters and spaces in urls are written as %20.  An empty table gives no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", base32_sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("n"))
    largest = rows.where(F.col("n") >= least_revisit).groupBy("digest", "n").agg(F.max("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    largest = largest.select(F.col("digest").alias("d"), F.col("n").alias("dn"), "keeper")
    told = rows.join(largest, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("dn")), "left")
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    rid = F.concat(F.lit("<urn:page:"), name, F.lit(":"), F.col("digest"), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), name)), r"[\x00-\x20\x7f]", "%20")
    # (the keeper of a group without any id is null: all its rows are then written in full)
    revisit = F.col("keeper").isNotNull() & ~F.coalesce(F.col("id") == F.col("keeper"), F.lit(False))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    of = ("Content-Type", F.lit("application/http;msgtype=response"))
    kept = F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))
    main = F.when(
        revisit, _record("revisit", rid, [*common, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", kept), of], http)
    ).otherwise(_record("response", rid, [*common, digest, of], F.concat(http, F.col("payload"))))
    asked = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nUser-Agent: maskwright\r\n\r\n"))
    request = _record("request", rid_of(rid, "request"), [*common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http;msgtype=request"))], asked)
    facts = F.concat(F.lit("page-id: "), name, F.lit("\r\npayload-length: "), F.col("n").cast("string"), F.lit("\r\n"))
    meta = _record("metadata", rid_of(rid, "metadata"), [*common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], facts)
    records = told.select(F.explode(F.array(main, request, meta)).alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def rid_of(rid: Column, part: str) -> Column:
    return F.concat(F.regexp_replace(rid, ">$", ""), F.lit(f":{part}>"))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        line = line.strip()
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and last:  # folded
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            last, _, value = line.decode("utf-8", "replace").partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {fields.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        yield fields, block


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, body


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("kind", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = fields.get("warc-type", "")
    row = {"kind": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": None, "payload_bytes": None, "fields": [], "payload": None}
    if kind == "response":
        _, body = split_http(block)
        row["payload_digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
        row["payload_bytes"] = len(body)
        row["payload"] = body if with_payload else None
        if f"sha1:{row['payload_digest']}" != fields.get("warc-payload-digest", f"sha1:{row['payload_digest']}"):
            raise ValueError(f"record {row['record_id']}: its payload is not the one digested")
    elif kind == "revisit":
        http, _ = split_http(block)
        row["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        row["payload_bytes"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif kind == "request":
        row["fields"] = [("message", block.decode("utf-8", "replace"))]
    elif kind == "metadata":
        parts = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
        row["fields"] = list({k.strip(): v.strip() for k, _, v in parts}.items())
    return row


def _read(with_payload: bool):
    def f(batches):
        for batch in batches:
            for content in batch["content"]:
                raw = content.as_buffer()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw)), 1 << 20) if raw[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(pa.BufferReader(raw))
                rows, size = [], 0
                for fields, block in parse(stream):
                    rows.append(_row(fields, block, with_payload))
                    size += 400 + (len(block) if with_payload else 0)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return f


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files (plain or gzip) below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_read(with_payload), RECORD)


def read_captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and the metadata that are concurrent to it.

    Records without a capture (requests that name none, warcinfo, …) give no row; a capture without a
    request or metadata has null there; captures that repeat an identifier each stay a row and share
    the request and metadata.  No file, no row.
    """
    records = read_records(spark, path, with_payload)
    capture = F.struct("record_id", "kind", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload")
    is_capture = F.col("kind").isin("response", "revisit")
    first = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("record_id", "fields")), ignorenulls=True)
    whole = records.groupBy(F.when(is_capture, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("transaction")).agg(F.collect_list(F.when(is_capture, capture)).alias("captures"), first("request").alias("request"), first("metadata").alias("metadata"))
    return whole.select(F.explode("captures").alias("capture"), "request", "metadata")


def page_id_of(record_id: Column) -> Column:
    """The page's id in an identifier of write_archive; null for none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d+):", 1), F.lit("")).cast("long")
