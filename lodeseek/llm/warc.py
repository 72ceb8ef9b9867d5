"""WARC archives as a PySpark Python data source, read and written.

Format "lodeseek_warc". Reading plans partitions of whole files (small files share one), takes
equality, IN and prefix predicates on record_type and the header columns, parses a record's headers
first, and seeks past (plain files) or inflates without keeping (.gz files) the block of a record
that isn't wanted. Writing makes files of about file_bytes under temporary names that name the job;
only the files of successful tasks get their final name when the job commits, and what lost or
repeated tasks of the job left is deleted then.

Options: path (file://, a plain path, or any scheme that pyarrow.fs opens), payload ("false" skips
every payload), compression ("none" or "gzip", one member for each record), partition_bytes, file_bytes.

Defined results of write_pages and read_pages: null html is an empty payload; a null URL has no
header; repeated rows make repeated records; an empty table makes no record. Payloads of any size
are held one at a time. Equal payloads are told by SHA-1 and length. Of rows with equal payloads
and the largest id all are responses; a null id never is the largest.
"""

from __future__ import annotations

import base64
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from lodeseek.llm.common import fresh_path, table, written

NAME = "lodeseek_warc"
READ_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, content_type string, payload_bytes long, payload binary"
WRITE_COLUMNS = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload")
#: Column -> WARC header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = FILE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
BLOCK = 1 << 20
#: Compressed bytes that are inflated at a time: what a member leaves over of them is given again.
INFLATE = 1 << 13
FIXED_DATE = "2000-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


# --- reading -------------------------------------------------------------------------------------


class _Bytes:
    """A stream with reads of exact length and skipping; inflates .gz files member by member.

    What was read and not yet taken lies in held from at on; each byte is moved a bounded number of times.
    """

    def __init__(self, raw: pa.NativeFile, size: int, gzip: bool) -> None:
        self.raw, self.size, self.gzip = raw, size, gzip
        self.held, self.at = bytearray(), 0
        self.inflate = zlib.decompressobj(31) if gzip else None
        self.packed, self.next = memoryview(b""), 0

    def _inflated(self) -> bytes | None:
        """Some more bytes of a .gz file, perhaps none; None at the end."""
        if self.next >= len(self.packed):
            self.packed, self.next = memoryview(self.raw.read(BLOCK)), 0
            if not self.packed:
                return None
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        part = self.packed[self.next : self.next + INFLATE]
        out = self.inflate.decompress(part)
        self.next += len(part) - len(self.inflate.unused_data)
        return out

    def _more(self) -> bool:
        while (out := self._inflated() if self.gzip else self.raw.read(BLOCK) or None) is not None:
            if out:
                if self.at > BLOCK:
                    del self.held[: self.at]
                    self.at = 0
                self.held += out
                return True
        return False

    def head(self) -> bytes | None:
        """Up to and with the next blank line, however long; None at the end."""
        seen = self.at
        while (end := self.held.find(b"\r\n\r\n", max(self.at, seen - 3))) < 0:
            seen, was = len(self.held), self.at
            if not self._more():
                if self.held[self.at :].strip(b"\r\n"):
                    raise ValueError("WARC file ends within a header")
                return None
            seen -= was - self.at
        out, self.at = bytes(self.held[self.at : end + 4]), end + 4
        return out

    def take(self, n: int) -> bytes:
        parts = io.BytesIO()
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("WARC file ends within a record")
            some = self.held[self.at : self.at + n]
            self.at += len(some)
            parts.write(some)
            n -= len(some)
        return parts.getvalue()

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held) - self.at)
        self.at, n = self.at + inside, n - inside
        if n and not self.gzip:
            if self.raw.tell() + n > self.size:
                raise ValueError("WARC file ends within a record")
            self.raw.seek(self.raw.tell() + n)
            return
        while n:
            if not self._more():
                raise ValueError("WARC file ends within a record")
            inside = min(n, len(self.held) - self.at)
            self.at, n = self.at + inside, n - inside


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the last one."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[last := name.strip().lower()] = value.strip()
    return out


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, int]] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes predicates on one header column; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        out: list[_Files] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type != pafs.FileType.File or not re.search(r"\.warc(\.gz)?$", f.path):
                continue
            if not out or room < f.size:
                out.append(_Files([]))
                room = self.partition_bytes
            out[-1].paths.append((f.path, f.size))
            room -= f.size
        return out or [_Files([])]

    def _wanted(self, columns: dict[str, str | None]) -> bool:
        for f in self.tests:
            value = columns[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for path, size in partition.paths:
            for row in self._records(path, size):
                rows.append(row)
                held += 400 + len(row[-1] or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def _records(self, path: str, size: int) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        with fs.open_input_file(path) as raw:
            stream = _Bytes(raw, size, path.endswith(".gz"))
            while (head := stream.head()) is not None:
                head = head.lstrip(b"\r\n")
                if not head:  # what ends a record
                    continue
                if not head.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one should begin in {path}")
                fields = parse_headers(head)
                length = int(fields["content-length"])
                columns = {n: fields.get(h.lower()) for n, h in HEADERS.items()}
                if not self._wanted(columns):
                    stream.skip(length)
                    continue
                payload, payload_bytes = None, length
                if (columns["content_type"] or "").startswith("application/http"):
                    http = stream.head() or b""
                    length -= len(http)
                    payload_bytes = int(parse_headers(http).get("content-length", length))
                if self.payload:
                    payload = stream.take(length)
                else:
                    stream.skip(length)
                yield (*columns.values(), payload_bytes, payload)


# --- writing -------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.gzip, self.job = options["path"], options.get("compression", "none") == "gzip", uuid.uuid4().hex
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in zip(*(batch.column(c) for c in WRITE_COLUMNS), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, size = fs.open_output_stream(self._open_name(root, names[-1])), 0
                    record = self.record(*(x.as_py() for x in row))
                    if self.gzip:
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        record = deflate.compress(record) + deflate.flush()
                    out.write(record)
                    size += len(record)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def _open_name(self, root: str, name: str) -> str:
        return f"{root}/.{self.job}-{name}.open"

    def _sweep(self, fs: pafs.FileSystem, root: str) -> None:
        """Delete what this job left under temporary names."""
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.move(self._open_name(root, name), f"{root}/{name}")
        self._sweep(fs, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._sweep(*_open(self.path))

    @staticmethod
    def record(record_type: str, record_id: str | None, refers_to: str | None, target_uri: str | None, payload_digest: str | None, payload_bytes: int, payload: bytes | None) -> bytes:
        body = b"" if record_type == "revisit" else payload or b""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
        fields = [
            ("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", FIXED_DATE),
            ("WARC-Target-URI", target_uri and quote(target_uri, safe="!#$%&'()*+,/:;=?@[]~")),
            ("WARC-Payload-Digest", payload_digest and f"sha1:{payload_digest}"), ("WARC-Refers-To", refers_to),
            ("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None),
            ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(body))),
        ]
        head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None) + "\r\n"
        return head.encode() + http + body + b"\r\n\r\n"


class WarcDataSource(DataSource):
    """spark.read.format("lodeseek_warc").load(path); df.write.format("lodeseek_warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are written once: use mode('append') and a new path")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- pages ---------------------------------------------------------------------------------------


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def base32(hex_digest: Column) -> Column:
    """A SHA-1's 40 hexadecimal digits as 32 of base 32: each five of the one are four of the other."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chunk = lambda i: F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 10).cast("int")
    return F.concat(*(F.substr(F.lit(digits), 1 + F.shiftright(chunk(i), 15 - 5 * j).bitwiseAND(31), F.lit(1)) for i in range(8) for j in range(4)))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    """Archive page_id, url, html: equal payloads of min_bytes or more once, as the largest page_id's response."""
    register(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), F.encode(html, "UTF-8").alias("payload"), F.sha1(html).alias("hex"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # Summed up by digest before the shuffle; only digests that repeat are joined back, from a written
    # table: Spark knows its size and broadcasts it if small, else it can split a digest that many pages share.
    repeated = written(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("hex", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    marked = rows.join(repeated, ["hex", "payload_bytes"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_id(F.col("page_id")).alias("record_id"), F.when(revisit, record_id(F.col("keeper"))).alias("refers_to"),
        "target_uri", base32(F.col("hex")).alias("payload_digest"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    marked.write.format(NAME).mode("append").option("compression", compression).save(path)


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of every archived page."""
    register(spark)
    records = spark.read.format(NAME).option("payload", str(payload).lower()).load(path)
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page_of(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url"), "record_type", page_of(F.col("refers_to")).alias("refers_to"),
        "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "payload",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are taken from the payload that was read, a revisit's from its headers.
    """
    path = fresh_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, compression="gzip")
    response = F.col("record_type") == "response"
    back = read_pages(spark, path).withColumns({"read_bytes": F.octet_length("payload").cast("long"), "read_hex": F.sha1("payload")})
    return back.select(
        "page_id", F.when(response, F.col("read_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, base32(F.col("read_hex"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT hex, n, max(page_id) AS keeper FROM p GROUP BY hex, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(p.hex, 1 + 5 * (j // 4), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p JOIN k ON p.hex = k.hex AND p.n = k.n
"""
