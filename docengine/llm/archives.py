"""ARC archives (versions 1 and 2) to WARC archives, by their headers and declared lengths.

An ARC file begins with a version block (`filedesc://...`), whose first line gives the version. Each record
is a header line, which has five fields in version 1 and ten in version 2, and as many bytes as its last
field declares. ``to_warc`` writes what a WARC file needs besides:

* a record id, made from the archive's name and the record's offset, so that it is always the same,
* the date, from 14 digits (missing ones: the earliest date) to `2001-02-03T04:05:06Z`,
* the type: `warcinfo` for version blocks, `response` for HTTP responses, `resource` for other content,
  `revisit` for a payload of ``smallest`` bytes or more that another record holds too,
* block and payload digests (SHA-1).

Files are written and read by Spark's text source, with the end of a record as line separator and gzip.
So they need no local files, a lost task is written anew, and only what is parsed goes through Python: a
stream of lines per file, of which a record at a time is held. Plain files (without .gz) are read whole,
up to 2 GB each.

Nulls: a null block counts as empty; a null or empty url becomes `urn:none`. An archive whose header line
doesn't fit its version, or that ends within a record, has a last row that says so in ``problem``, and
nothing after it is read. Files without records and empty folders give no rows. Of rows with equal
payloads and equal rank, one is the response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from uuid import UUID

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.stored import folder, stored
from docengine.llm.words import lean

# The formats' field names, header lines and ends of records.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_HEADER = {
    1: re.compile(rb"(\S.*) (\S+) (\d{4,17}) (\S.*) (\d+)\r?\n"),
    2: re.compile(rb"(\S.*) (\S+) (\d{4,17}) (\S.*) (\S+) \S+ \S+ \S+ \S+ (\d+)\r?\n"),
}
VERSION_LINE = re.compile(rb"([12]) \S+ .*")
WARC_END = "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EARLIEST = "00000101000000"
LONGEST_HEADER = 1 << 16

_FAST = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "0"}


class Ended(Exception):
    """The archive ends within a record."""


class Reader:
    """The bytes of one file, from its lines."""

    def __init__(self, lines: Iterator[bytes]) -> None:
        self.lines, self.held, self.at = lines, deque(), 0

    def line(self) -> bytes:
        """The next line with its end, or b'' at the end of the file."""
        out = b""
        while True:
            if not self.held:
                x = next(self.lines, None)
                if x is None:
                    break
                self.held.append(x)
            first = self.held.popleft()
            end = first.find(b"\n") + 1
            if end:
                if end < len(first):
                    self.held.appendleft(first[end:])
                out += first[:end]
                break
            out += first
        self.at += len(out)
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        parts, have = [], 0
        while have < n:
            x = self.held.popleft() if self.held else next(self.lines, None)
            if x is None:
                raise Ended
            if have + len(x) > n:
                self.held.appendleft(x[n - have :])
                x = x[: n - have]
            parts.append(x)
            have += len(x)
        self.at += n
        return b"".join(parts)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parts(block: bytes) -> tuple[bytes | None, bytes]:
    """The HTTP header of a block (None if it isn't an HTTP response) and the payload."""
    if not block.startswith(b"HTTP/"):
        return None, block
    ends = [(at, at + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (at := block.find(e)) >= 0]
    if not ends:
        return block, b""
    _, end = min(ends)
    return block[:end], block[end:]


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode("utf-8", "replace")


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.sha256(f'{name}:{offset}'.encode()).digest()[:16], version=5)}>"


_PAYLOAD = "payload_bytes long, payload_digest string, payload_crc long, block_digest string, http binary, http_digest string"
ARC_COLUMNS = f"archive string, start long, version int, url string, ip string, date string, content_type string, {_PAYLOAD}, record_id string, problem string"
WARC_COLUMNS = "archive string, start long, type string, record_id string, url string, date string, payload_bytes long, payload_digest string, http string, refers_to string, problem string"


def _described(block: bytes) -> tuple[dict, bytes]:
    http, payload = _parts(block)
    return {
        "payload_bytes": len(payload),
        "payload_digest": _sha1(payload),
        "payload_crc": zlib.crc32(payload),
        "block_digest": _sha1(block),
        "http": http,
        "http_digest": _sha1(http or b""),
    }, payload


def arc_records(name: str, reader: Reader) -> Iterator[dict]:
    """The records of one ARC file in order, version blocks too."""
    version = None
    while True:
        start = reader.at
        head = reader.line()
        while head in (b"\n", b"\r\n"):
            start, head = reader.at, reader.line()
        if not head:
            return
        row = {"archive": name, "start": start, "version": version, "record_id": record_id(name, start)}
        if len(head) > LONGEST_HEADER:
            found = None
        elif version is None:  # the version block: its length is the last field, its first line has the version
            found = ARC_HEADER[1].fullmatch(head) if head.startswith(b"filedesc:") else None
        else:
            found = ARC_HEADER[version].fullmatch(head)
        if found is None:
            yield row | {"problem": "header"}
            return
        fields = found.groups()
        try:
            block = reader.take(int(fields[-1]))
            end = reader.line()
            if not end:
                raise Ended
            if end.strip(b"\r\n"):
                yield row | {"problem": "length"}
                return
        except Ended:
            yield row | {"problem": "truncated"}
            return
        kind = fields[3]
        if version is None:
            line = VERSION_LINE.match(block)
            if line is None:
                yield row | {"problem": "version"}
                return
            version = row["version"] = int(line[1])
            kind = kind.split(b" ")[0]  # in version 2 more fields follow
        described, payload = _described(block)
        yield row | described | {"url": _text(fields[0]), "ip": _text(fields[1]), "date": _text(fields[2]), "content_type": _text(kind), "block": block, "payload": payload}


def _hex(digest: str | None) -> str | None:
    return None if digest is None else base64.b32decode(digest.removeprefix("sha1:")).hex()


def warc_records(name: str, reader: Reader) -> Iterator[dict]:
    """The records of one WARC file in order. Digests are hex; a revisit's payload is described by its headers."""
    while True:
        start = reader.at
        head = reader.line()
        while head == b"\r\n":
            start, head = reader.at, reader.line()
        if not head:
            return
        row = {"archive": name, "start": start}
        if not head.startswith(b"WARC/1."):
            yield row | {"problem": "header"}
            return
        headers: dict[str, str] = {}
        while (line := reader.line().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        row |= {"type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "refers_to": headers.get("warc-refers-to")}
        try:
            block = reader.take(int(headers["content-length"]))
            end = reader.take(4)
        except (Ended, KeyError, ValueError):
            yield row | {"problem": "truncated"}
            return
        if end != WARC_END.encode():
            yield row | {"problem": "length"}
            return
        http, payload = _parts(block)
        row |= {"http": _text(http), "payload": payload}
        wrong = "warc-block-digest" in headers and headers["warc-block-digest"] != _sha1(block)
        if row["type"] == "revisit":
            size = re.search(r"(?im)^content-length: *(\d+)", row["http"] or "")
            row |= {"payload_bytes": int(size[1]) if size else None, "payload_digest": _hex(headers.get("warc-payload-digest"))}
        else:
            digest = _sha1(payload)
            wrong |= "warc-payload-digest" in headers and headers["warc-payload-digest"] != digest
            row |= {"payload_bytes": len(payload), "payload_digest": _hex(digest)}
        yield row | {"problem": "digest" if wrong else None}


def _read(spark: SparkSession, path: str, records, columns: str, extra: str | None) -> DataFrame:
    """All records of the files of a folder, with the column ``extra`` (block or payload) if it is named."""
    schema = columns + (f", {extra} binary" if extra else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((f, x) for b in batches for f, x in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True))
        rows, held = [], 0
        for file, own in groupby(lines, key=lambda r: r[0]):
            # lines come without their ends
            for r in records(file.rpartition("/")[2], Reader(x if x.endswith(b"\n") and not file.endswith(".gz") else x + b"\n" for _, x in own)):
                rows.append({n: r.get(n) for n in names})
                held += len(r.get("block") or r.get("payload") or b"") if extra else 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    by_line = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").schema("value string").text(path)
    by_line = by_line.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*{[!z],[!g]z,[!.]gz}").load(path)
    plain = plain.select(F.col("path").alias("file"), F.col("content").alias("value"))
    return by_line.mapInArrow(lean(run), schema).unionByName(plain.mapInArrow(lean(run), schema))


def read_arc(spark: SparkSession, path: str, block: bool = True) -> DataFrame:
    """The records of all ARC files of a folder."""
    return _read(spark, path, arc_records, ARC_COLUMNS, "block" if block else None)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all WARC files of a folder."""
    return _read(spark, path, warc_records, WARC_COLUMNS, "payload" if payload else None)


def _write(values: Column, first: Column, df: DataFrame, path: str, end: str) -> None:
    """A file a task: ``first`` (the file's own record) and the records, each followed by ``end``."""
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.when(begins, F.concat(first, F.lit(end), values)).otherwise(values).alias("value")).write.options(lineSep=end, **_FAST).mode("append").text(path)


def safe_url(url: Column) -> Column:
    """The url without white space, control and other characters that a header line can't have, in percent form."""
    escaped = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike("^[!-~]$") | (c == ""), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")
    return F.when(F.coalesce(url, F.lit("")) == "", "urn:none").when(url.rlike("[^!-~]"), escaped).otherwise(url)


def write_arc(records: DataFrame, path: str, version: int) -> None:
    """Adds ARC files of a version to a folder. records: url, ip, date (digits), content_type, status and block (text)."""
    block = F.coalesce(F.col("block").cast("string"), F.lit(""))
    common = [safe_url(F.col("url")), F.coalesce("ip", F.lit("0.0.0.0")), F.coalesce("date", F.lit(EARLIEST)), F.coalesce("content_type", F.lit("no-type"))]
    others = [] if version == 1 else [F.coalesce(F.col("status").cast("string"), F.lit("-")), *map(F.lit, ("-", "-", "0", "-"))]
    line = F.concat_ws(" ", *common, *others, F.octet_length(block).cast("string"))
    about = f"{version} 0 docengine\n{ARC_FIELDS[version]}\n"
    name = F.concat(F.lit(f"filedesc://v{version}-"), F.spark_partition_id().cast("string"), F.lit(".arc 0.0.0.0 20000101000000 text/plain " + ("" if version == 1 else "200 - - 0 - ") + f"{len(about)}\n{about}"))
    _write(F.concat(line, F.lit("\n"), block), name, records, path, "\n")


def iso_date(digits: Column) -> Column:
    whole = F.overlay(F.lit(EARLIEST), F.substring(digits, 1, 14), 1)
    return F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def _warc(columns: dict[str, Column], block: Column) -> Column:
    """A record but for its end; null columns give no header."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in columns.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, size), F.lit(WARC_END), block)


def repeats(records: DataFrame, prefer: Column, smallest: int = 1000) -> DataFrame:
    """(record_id, refers_to, refers_url, refers_date) for the records whose payload another, preferred one holds.

    Payloads are equal if their sizes, SHA-1 and CRC-32 are. Of equal ones the largest in the order of
    ``prefer``, then archive and offset is kept.
    """
    key = ["payload_bytes", "payload_digest", "payload_crc"]
    large = records.filter(F.col("problem").isNull() & (F.col("payload_bytes") >= smallest) & F.col("http").isNotNull())
    large = large.select(*key, "record_id", F.struct(prefer.alias("prefer"), "archive", "start", "record_id", "url", "date").alias("own"))
    kept = large.groupBy(*key).agg(F.max("own").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    return large.join(kept, key).filter("record_id <> kept.record_id").select("record_id", F.col("kept.record_id").alias("refers_to"), F.col("kept.url").alias("refers_url"), F.col("kept.date").alias("refers_date"))


def to_warc(spark: SparkSession, arc: str, warc: str, prefer: Column | None = None, smallest: int = 1000, most_broadcast: int = 1 << 17) -> DataFrame:
    """Converts a folder of ARC files to a folder of WARC files; returns the ARC records that couldn't be read.

    ``prefer`` is an expression over ARC_COLUMNS: of equal payloads, that of the record with its largest value
    is kept, and the others refer to it. What is known of the repeated records is broadcast if there are at
    most most_broadcast of them, else joined by a shuffle.
    """
    known = stored(read_arc(spark, arc, block=False))
    again = stored(repeats(known, F.lit(0) if prefer is None else prefer, smallest))
    small = again.limit(most_broadcast + 1).count() <= most_broadcast
    records = read_arc(spark, arc).filter("problem is null").join(F.broadcast(again) if small else again, "record_id", "left")
    described, revisit, http = F.col("url").startswith("filedesc:"), F.col("refers_to").isNotNull(), F.col("http").isNotNull()
    about = F.concat(F.lit("software: docengine\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC "), F.col("version").cast("string"), F.lit("\r\n"))
    block = F.when(described, about).when(revisit, F.col("http")).otherwise(F.col("block").cast("string"))
    value = _warc({
        "WARC-Type": F.when(described, "warcinfo").when(revisit, "revisit").when(http, "response").otherwise("resource"),
        "WARC-Record-ID": F.col("record_id"),
        "WARC-Date": iso_date(F.col("date")),
        "WARC-Filename": F.when(described, F.col("archive")),
        "WARC-Target-URI": F.when(~described, F.col("url")),
        "WARC-IP-Address": F.when(~described & (F.col("ip") != "0.0.0.0"), F.col("ip")),
        "WARC-Block-Digest": F.when(~described, F.when(revisit, F.col("http_digest")).otherwise(F.col("block_digest"))),
        "WARC-Payload-Digest": F.when(~described, F.col("payload_digest")),
        "WARC-Profile": F.when(revisit, SAME_PAYLOAD),
        "WARC-Refers-To": F.col("refers_to"),
        "WARC-Refers-To-Target-URI": F.col("refers_url"),
        "WARC-Refers-To-Date": F.when(revisit, iso_date(F.col("refers_date"))),
        "Content-Type": F.when(described, "application/warc-fields").when(http, "application/http; msgtype=response").otherwise(F.col("content_type")),
    }, block)
    records.select(value.alias("value")).write.options(lineSep=WARC_END, **_FAST).text(warc)
    return known.filter("problem is not null")


def _page_id() -> Column:
    return F.expr(r"cast(nullif(regexp_extract(cast(http as string), '(?m)^X-Page-Id: (-?[0-9]+)', 1), '') as bigint)")


def page_records(pages: DataFrame) -> DataFrame:
    """ARC records of pages: each an HTTP response whose header has the page's id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")), F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string"))]
    head = F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    date = F.expr("date_format(timestamp_seconds(946684800 + pmod(coalesce(page_id, 0), 100000000)), 'yyyyMMddHHmmss')")
    return pages.select(F.col("url").cast("string").alias("url"), F.lit("0.0.0.0").alias("ip"), date.alias("date"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status"), F.concat(head, F.lit(WARC_END), html).alias("block"))


def op12_archives(spark, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files and read back: per page its payload's size, digest and record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    base = folder(spark)
    odd = F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0))
    for version in (1, 2):
        write_arc(page_records(pages.filter(odd == version - 1)), f"{base}/arc", version)
    to_warc(spark, f"{base}/arc", f"{base}/warc", _page_id())
    back = stored(read_warc(spark, f"{base}/warc", payload=False).filter("type in ('response', 'revisit')").withColumn("page_id", _page_id()))
    out = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    responses = back.filter("type = 'response'")
    kept = responses.select("record_id", F.col("page_id").alias("refers_page"))
    revisits = back.filter("type = 'revisit'").drop("record_id").join(kept, F.expr("refers_to = record_id"), "left")
    return responses.select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*out, F.col("refers_page").alias("refers_to")))
