"""Legacy archive converter: ARC files of versions 1 and 2 into WARC records, and WARC archives read back.

An ARC file starts with a version block whose first lines name the version and the fields of the header lines;
each record is a header line, a body of the declared length, and a newline. Both versions are read and written; a
batch of pages goes half through either. Converted records get an identifier from their key and content (and from
their place, where rows repeat a key), an ISO timestamp, a type, and SHA-1 and SHA-256 digests that ARC lacks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.shared import shared_dir, utf8

#: Payloads of fewer bytes never become revisits.
LEAST = 100
#: Records of one archive file at most, and bytes of records that a file stands for on average.
RECORDS, FILE = 10_000, 64 << 20
#: Bytes of blocks after which a reader hands its records on.
BATCH = 8 << 20
# The field lines of ARC versions 1 and 2.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def write_arc(version: int, name: bytes, records: list[tuple[bytes, bytes, bytes, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, content type, body)."""
    lines = b"%d 0 cellweave\n%s\n" % (version, ARC_FIELDS[version])
    if version == 1:
        head = b"filedesc://%s 0.0.0.0 19960101000000 text/plain %d\n" % (name, len(lines))
    else:
        head = b"filedesc://%s 0.0.0.0 19960101000000 text/plain 200 - - 0 %s %d\n" % (name, name, len(lines))
    out, at = [head + lines + b"\n"], len(head) + len(lines) + 1
    for url, date, kind, body in records:
        if version == 1:
            line = b"%s 0.0.0.0 %s %s %d\n" % (url, date, kind, len(body))
        else:
            line = b"%s 0.0.0.0 %s %s 200 %s - %d %s %d\n" % (url, date, kind, hashlib.md5(body).hexdigest().encode(), at, name, len(body))
        out += [line, body, b"\n"]
        at += len(line) + len(body) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and body of each record; the version block says how header lines read.

    Fields are counted from the right where there are more than declared: a URL may hold spaces. A header line
    of too few fields, an unknown version or a body shorter than declared raises ValueError."""
    at, fields = 0, None
    while at < len(data):
        if data[at] == 10:
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without an end")
        line = data[at:end].rstrip(b"\r")
        names = fields or ARC_FIELDS[1].split()
        parts = line.rsplit(b" ", (len(names) if fields else line.count(b" ") + 1) - 1)
        try:
            size = int(parts[-1])
        except ValueError as e:
            raise ValueError("an ARC header line without a length") from e
        body = data[end + 1 : end + 1 + size]
        if size < 0 or len(body) < size:
            raise ValueError("an ARC body shorter than declared")
        at = end + 1 + size
        if fields is None:
            first, _, rest = body.partition(b"\n")
            version = int(first.split(b" ")[0]) if first.split(b" ")[0].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError("an unknown ARC version")
            fields = rest.partition(b"\n")[0].split() or ARC_FIELDS[version].split()
            continue
        if len(parts) != len(fields):
            raise ValueError("an ARC header line of too few fields")
        yield dict(zip(fields, parts, strict=True)), body


def stamp(date: bytes) -> str:
    """The ISO form of 14 (or 12, or 8) digits; other dates are 1970."""
    for form, n in (("%Y%m%d%H%M%S", 14), ("%Y%m%d%H%M", 12), ("%Y%m%d", 8)):
        if len(date) == n and date.isdigit():
            try:
                return datetime.strptime(date.decode(), form).replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                break
    return "1970-01-01T00:00:00Z"


def record_id(key: str, digest: str, place: str = "") -> str:
    """place tells apart records of one key; without it, a record of this key and payload can be named from elsewhere."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((key, digest, place)))}>"


def warc_record(fields: dict[bytes, bytes], body: bytes, key: str, refers_to: str | None, place: str = "", named: bool = True) -> bytes:
    """One WARC record but its last newline; a revisit has headers only. named: whether one record bears the key it refers to."""
    sha256 = hashlib.sha256(body).hexdigest()
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to else b"response"), b"WARC-Record-ID: " + record_id(key, sha256, place).encode(),
        b"WARC-Date: " + stamp(fields[b"Archive-date"]).encode(), b"WARC-Target-URI: " + fields[b"URL"], b"WARC-IP-Address: " + fields[b"IP-address"],
        b"WARC-Payload-Digest: sha256:" + sha256.encode(), b"WARC-Block-Digest: sha1:" + hashlib.sha1(b"" if refers_to else body).hexdigest().encode(),
        b"Content-Type: " + fields[b"Content-type"], b"X-Payload-Length: %d" % len(body), b"X-Source-Key: " + key.encode(),
    ]
    if refers_to:
        head += [b"WARC-Profile: " + REVISIT.encode(), b"X-Refers-To-Key: " + refers_to.encode()]
        if named:
            head.append(b"WARC-Refers-To: " + record_id(refers_to, sha256).encode())
        body = b""
    head.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r"


def read_warc(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by declared lengths; one record is held at a time."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = {}
        while (line := data.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        block = data.read(size)
        if len(block) < size:
            raise ValueError("a WARC block shorter than declared")
        yield head, block


def clean_url(url: bytes | None) -> bytes:
    """A URL that fits on a header line: spaces and controls as %XX; none is `about:blank`."""
    if not url:
        return b"about:blank"
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url)


def through_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(page_id, refers_to, value): each page through an ARC file of its batch, of one of these versions, into a WARC record.

    pages: page_id, url, payload (bytes), refers_to, repeated and named (of warc_record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            for turn, version in enumerate(versions):
                b = batch.take(pa.array(range(turn, batch.num_rows, len(versions)), pa.int64()))
                if not b.num_rows:
                    continue
                ids, urls, bodies, refers, repeated, named = (c.to_pylist() for c in b.columns)
                arc = write_arc(version, b"batch.arc", [(clean_url(u), b"20240101000000", b"text/html", p) for u, p in zip(urls, bodies, strict=True)])
                out = [
                    warc_record(fields, body, "" if i is None else str(i), None if r is None else str(r), f"{part}-{k}-{turn}-{n}" if again else "", one)
                    for n, ((fields, body), i, r, again, one) in enumerate(zip(read_arc(arc), ids, refers, repeated, named, strict=True))
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.binary())], ["page_id", "refers_to", "value"])

    wanted = pages.select("page_id", F.col("url").cast("binary").alias("url"), "payload", "refers_to", "repeated", "named")
    return wanted.mapInArrow(run, "page_id long, refers_to long, value binary")


def with_refers_to(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id of the same payload, where that is another page.

    Besides, repeated: whether other rows have the page_id; named: whether just one row has the page_id referred to.
    Ids are joined by digest first; payloads move once, by page, however many pages share a digest."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8("html").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("none", F.col("page_id").isNull()).withColumn("id", F.coalesce("page_id", F.lit(0)))
    ids = p.select("none", "id", "digest", (~F.col("none") & (F.octet_length("payload") >= LEAST)).alias("able"))
    known = ids.where("able").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = ids.groupBy("none", "id").count().where("count > 1").select("none", "id", F.lit(True).alias("repeated"))
    notes = ids.join(known, "digest", "left").join(again, ["none", "id"], "left")
    notes = notes.select("none", "id", "digest", F.when(F.col("able") & (F.col("first") < F.col("id")), F.col("first")).alias("refers_to"), "repeated")
    notes = notes.where("refers_to is not null or repeated").distinct()
    also = again.where("not none").select(F.col("id").alias("refers_to"), F.col("repeated").alias("many"))
    p = p.join(notes.join(also, "refers_to", "left"), ["none", "id", "digest"], "left")
    return p.select("page_id", "url", "payload", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated"), F.col("many").isNull().alias("named"))


def write_archives(records: DataFrame, path: str, most: int = RECORDS) -> None:
    """Gzip files of WARC records under path. Spark's text writer adds the newline that ends each record.

    Records stay in the partitions they are in; `most` of them make a file at most."""
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: key, record_id, type, target_uri, date, payload_bytes, payload_digest, refers_to, block."""
    names = ["key", "record_id", "record_type", "target_uri", "date", "payload_bytes", "payload_digest", "refers_to", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for h, block in read_warc(gzip.open(io.BytesIO(data.as_py()))):
                    body = block if h["WARC-Type"] == "response" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if body is None else hashlib.sha256(body).hexdigest()
                    size = int(h["X-Payload-Length"]) if body is None else len(body)
                    rows.append((int(h["X-Source-Key"]) if h["X-Source-Key"] else None, h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Date"], size, digest, int(h["X-Refers-To-Key"]) if "X-Refers-To-Key" in h else None, body))
                    held += len(block)
                    if len(rows) == 500 or held > BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "key long, record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to long, block binary")


def convert_pages(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Write one WARC record a page (page_id, url, html) by way of ARC files, and read the archives back.

    Of pages of one payload of at least LEAST bytes, that of the smallest page_id is a response and the others
    revisit it; rows that repeat a page_id are responses if that is the smallest. Null html is an empty payload,
    a null url `about:blank`; a null page_id gives a response of null key, which nothing refers to. Extra columns
    are ignored. An empty table gives no rows. Archives stay in the shared folder.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    mean = pages.agg(F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0))).first()[0]
    write_archives(through_arc(with_refers_to(pages), versions), path, max(1, min(RECORDS, int(FILE / (mean + 1000)))))
    return read_archives(spark, path)
