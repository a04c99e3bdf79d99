"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block, whose first line tells how the header lines of its
records are built, and holds records of one header line and a block of the declared length.
The converter reads both versions by those lengths and writes WARC records with identifiers,
timestamps, types and digests made from what the ARC line says. Of equal payloads one stays a
response, the others become revisits of it.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import hashlib
import io
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.tables import small
from lorekeep.sources.collections import staged

#: Payloads from this size on are looked up for equal ones.
REVISIT_BYTES = 1000

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: int
    archive: str  # as the version block names it
    offset: int
    fields: dict[str, str]
    block: bytes


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of one ARC file after its version block; ends at the first header line that is none."""
    first = stream.readline()
    if not first.startswith(b"filedesc://"):
        return
    about = stream.read(int(first.split()[-1]))
    version = int(about.split(b"\n", 1)[0].split()[0])
    names = about.split(b"\n")[1].decode().split()
    at = len(first) + len(about)
    while True:
        line = stream.readline()
        if line in (b"\n", b"\r\n"):  # records are set apart by a line break that no length counts
            at += len(line)
            continue
        # Only the address may hold blanks: the other fields are counted from the end.
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            return
        block = stream.read(int(parts[-1]))
        yield ArcRecord(version, first.split()[0].decode(), at, dict(zip(names, parts)), block)
        at += len(line) + len(block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload; a block that is no HTTP answer is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def warc_date(arc_date: str) -> str:
    """ISO form of the 14 digits of an ARC date; shorter or odd ones are filled up as far as they go."""
    digits = (re.sub(r"\D", "", arc_date) + "19960101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    try:
        return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(calendar.timegm(time.strptime(digits, "%Y%m%d%H%M%S"))))
    except ValueError:
        return "1996-01-01T00:00:00Z"


def record_id(url: str, date: str, archive: str, offset: int) -> str:
    """The same identifier each time the same record is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {archive} {offset}')}"


_SCHEMA = (
    "file string, at long, version int, url string, ip string, date string, mime string, kind string, "
    "record_id string, head binary, payload_bytes long, digest string, digest32 string, page_id long"
)


def arc_records(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """Records of all ARC files below `path`, with what WARC needs to know about them.

    Each file is read by one task: files should be some hundred MB at most. `payload` adds the payload column.
    """
    schema = _SCHEMA + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in schema.split(",")]
        for batch in batches:
            for place, content in zip(batch["path"].to_pylist(), batch["content"]):
                file = place.rsplit("/", 1)[-1]
                raw = io.BytesIO(content.as_py())
                stream = gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw
                rows, held = [], 0
                for r in read_arc(stream):
                    head, body = split_http(r.block)
                    url, date = r.fields["URL"], warc_date(r.fields["Archive-date"])
                    digest = hashlib.sha1(body)
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    row = (
                        file, r.offset, r.version, url, r.fields["IP-address"], date, r.fields["Content-type"],
                        "response" if head else "resource", record_id(url, date, r.archive, r.offset), head, len(body),
                        digest.hexdigest(), base64.b32encode(digest.digest()).decode(),
                        int(page[1]) if page else None,
                    )
                    rows.append((*row, body) if payload else row)
                    held += len(body)
                    if held > 1 << 22:
                        yield _rows(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    return files.load(path).select("path", "content").mapInArrow(run, schema)


_TYPES = {"at": pa.int64(), "version": pa.int32(), "head": pa.binary(), "payload_bytes": pa.int64(),
          "page_id": pa.int64(), "payload": pa.binary()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def write_records(records: DataFrame, path: str) -> None:
    """One string column of whole records, written as gzip files through Spark's own writer and commit.

    The writer ends each record with a line break, which must be the record's own last byte.
    """
    records.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def write_arc(pages: DataFrame, path: str, arc_dates: Column | None = None) -> None:
    """Pages (page_id, url, html) as ARC files, one a task; tasks take turns in the two versions.

    NULL html is an empty payload, a NULL address is "-", blanks in an address are written as %20, and
    a NULL page_id leaves its header out.
    """
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))),
                          "yyyyMMddHHmmss")
    rows = pages.select(
        pages["page_id"], F.regexp_replace(F.coalesce(pages["url"], F.lit("-")), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("html"), (stamp if arc_dates is None else arc_dates).alias("date"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        about = f"{version} 0 lorekeep\n{ARC_FIELDS[version]}\n"
        opening = f"filedesc://{part}.arc 0.0.0.0 20240101000000 text/plain "
        opening += ("" if version == 1 else "200 - - 0 - ") + f"{len(about)}\n"
        yield pa.RecordBatch.from_arrays([pa.array([opening + about.removesuffix("\n")])], names=["value"])
        at = len(opening) + len(about)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(start, 256).to_pylist():
                    page = "" if r["page_id"] is None else f"X-Page-Id: {r['page_id']}\r\n"
                    body = r["html"]
                    size = len(body.encode())
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{page}Content-Length: {size}\r\n\r\n{body}"
                    length = len(block) - len(body) + size
                    more = "" if version == 1 else f"200 - - {at} {part}.arc "
                    line = f"{r['url']} 192.0.2.1 {r['date']} text/html {more}{length}\n"
                    out.append(line + block)
                    at += len(line.encode()) + length + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    write_records(rows.mapInArrow(run, "value string"), path)


def first_of_equal(slim: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """digest and the place of the record that others with this payload revisit: the largest page_id, NULL last.

    One row per payload that occurs twice or more; tasks reduce their own rows first.
    """
    place = F.struct("page_id", "file", "at", "record_id", "url", "date")
    return (
        slim.where(F.col("payload_bytes") >= least).groupBy("digest")
        .agg(F.max(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("digest").alias("known"), "first")
    )


def _crlf(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit("\r\n"))])


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_BYTES) -> None:
    """WARC files from all ARC files below `arc_path`.

    What is looked up for a record is one small row per repeated payload. It is broadcast while a count proves
    it small; beyond, both sides meet by digest, and payloads of their own or below `least` bytes meet nobody.
    """
    firsts = small(staged(first_of_equal(arc_records(spark, arc_path, False), least)))
    records = arc_records(spark, arc_path, True)
    key = F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("own "), "record_id"))
    joined = records.withColumn("key", key).join(firsts, F.col("key") == F.col("known"), "left")
    again = F.col("first").isNotNull() & (F.struct("file", "at") != F.struct("first.file", "first.at"))
    head = F.col("head").cast("string")
    block = F.when(again, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    kind = F.when(again, F.lit("revisit")).otherwise(F.col("kind"))
    mime = F.when(F.col("head") == F.lit(b""), F.col("mime")).otherwise(F.lit("application/http; msgtype=response"))
    revisit = F.when(
        again,
        _crlf(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}"),
            F.concat(F.lit("WARC-Refers-To: <"), F.col("first.record_id"), F.lit(">")),
            F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("first.url")),
            F.concat(F.lit("WARC-Refers-To-Date: "), F.col("first.date")),
        ),
    ).otherwise(F.lit(""))
    header = F.concat(
        _crlf(
            WARC_VERSION,
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
            F.concat(F.lit("WARC-Date: "), F.col("date")),
            F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
            F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest32")),
        ),
        revisit,
        _crlf(
            F.concat(F.lit("Content-Type: "), mime),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
            "",
        ),
    )
    # A record ends with two empty lines; the writer adds the last line break.
    write_records(joined.select(F.concat(header, block, F.lit("\r\n\r")).alias("value")), warc_path)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one WARC file."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all WARC files below `path`: its header, and what its payload measures.

    A revisit tells the size of the payload it stands for by the Content-Length of the HTTP header it kept.
    `verified`: the payload of a response has the digest that its header declares.
    """
    schema = ("record_id string, record_type string, url string, date string, refers_to_id string, page_id long, "
              "payload_bytes long, payload_digest string, verified boolean")
    names = [f.strip().split()[0] for f in schema.split(",")]
    types = _TYPES | {"verified": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch["path"].to_pylist(), batch["content"]):
                raw = io.BytesIO(content.as_py())
                rows = []
                for fields, block in read_warc(gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else raw):
                    head, body = split_http(block)
                    kind = fields["warc-type"]
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    size = re.search(rb"\r\nContent-Length: (\d+)\r\n", head) if kind == "revisit" else None
                    rows.append((
                        fields["warc-record-id"].strip("<>"), kind, fields["warc-target-uri"], fields["warc-date"],
                        fields.get("warc-refers-to", "").strip("<>") or None, int(page[1]) if page else None,
                        int(size[1]) if size else len(body), base64.b32decode(told).hex(),
                        None if kind == "revisit" else base64.b32encode(hashlib.sha1(body).digest()).decode() == told,
                    ))
                if rows:
                    columns = [pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    return files.load(path).select("path", "content").mapInArrow(run, schema)


def pages_through_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified for every page.

    The pages are written as ARC files, converted to WARC files and read from these. Of payloads of at
    least `least` bytes that are equal, the page with the largest page_id is the response (a NULL page_id
    counts as smallest; of rows alike one is taken), the others revisit it. An empty table gives an empty result.
    """
    pages = pages.select(pages["page_id"].cast(T.LongType()).alias("page_id"), pages["url"], pages["html"])
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", least)
    found = staged(warc_records(spark, f"{folder}/warc"))
    targets = found.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    revisits = found.where(F.col("record_type") == "revisit")
    # Only what is revisited is looked up, each of it once.
    wanted = revisits.select(F.col("refers_to_id").alias("target_id")).distinct()
    targets = targets.join(small(wanted), "target_id", "left_semi")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified"]
    others = found.where(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("long"))
    linked = revisits.join(targets, F.col("refers_to_id") == F.col("target_id"), "left")
    return others.select(*columns).unionByName(linked.select(*columns))
