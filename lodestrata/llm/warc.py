"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: the driver lists files and packs them into partitions. Filters on the record type and on header columns are
pushed down. A record's headers are parsed first; if it isn't wanted, or no column asks for its payload, its block is
skipped: by seeking in plain files and in members whose gzip header tells their length (the ``sl`` field, which this
writer sets), else by inflating without keeping.

Writing: each task attempt writes files of its own names; the commit writes one list of files, so files of failed or
repeated attempts are never read. Paths go through Arrow's file systems (local, file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import counted_side, cut, shared_folder

#: Column -> header of the record (names compare without case).
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "block_digest": "warc-block-digest", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "refers_to_uri": "warc-refers-to-target-uri", "profile": "warc-profile", "truncated": "warc-truncated"}
#: From the headers too, as a number; then what needs the HTTP headers; then what needs the whole payload.
HEADER_NUMBERS = {"content_length": "content-length"}
HTTP = {"http_status": "int", "http_content_length": "long"}
PAYLOAD = {"payload": "binary", "payload_length": "long", "payload_sha1": "string"}
SCHEMA = ", ".join([f"{c} string" for c in HEADERS] + ["content_length long"] + [f"{c} {t}" for c, t in (HTTP | PAYLOAD).items()] + ["headers map<string,string>", "file string", "offset long"])
#: Files are packed into partitions, and written files are closed, at about so many bytes; a batch is passed on at this many.
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 1 << 30, 8 << 20, 4096
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records with equal payloads of at least so many bytes are written once.
MIN_REVISIT_BYTES = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# Writing


def _value(text: str) -> str:
    """A header's value: control characters, which would end or break its line, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def member(record: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` tells the lengths of the whole member and of its content."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    length = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC 1.1 record; of a revisit only the HTTP headers are written, with length and digest of the full payload."""
    payload, kind = row.get("payload") or b"", row.get("record_type") or "response"
    http = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or date, "WARC-Target-URI": row.get("target_uri"), "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
    if kind == "revisit":
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": row.get("refers_to"), "WARC-Refers-To-Target-URI": row.get("refers_to_uri"), "WARC-Truncated": "length"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_value(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.packed, self.overwrite = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip", overwrite
        self.most = int(options.get("fileBytes", FILE_BYTES))
        self.date = options.get("date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if unknown := {f.name for f in schema} - {*HEADERS, "payload", "http_status"}:
            raise ValueError(f"no part of a record: {sorted(unknown)}")
        where, at = _place(self.path)
        where.create_dir(at, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, at = _place(self.path)
        files, out, size, name = [], None, 0, ""
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):  # one row at a time: a batch's payloads are never held twice
                raw = record_bytes({c: batch.column(k)[i].as_py() for k, c in enumerate(names)}, self.date)
                raw = member(raw) if self.packed else raw
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
                    out, size = where.open_output_stream(f"{at}/{name}", compression=None), 0
                out.write(raw)
                size += len(raw)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, at = _place(self.path)
        old = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("_files-")] if self.overwrite else []
        with where.open_output_stream(f"{at}/_files-{uuid.uuid4().hex}") as out:
            out.write("".join(f"{size}\t{name}\n" for m in messages if m for name, size in m.files).encode())
        for path in old:
            where.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        where, at = _place(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                where.delete_file(f"{at}/{name}")


# Reading


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


def list_files(path: str) -> list[tuple[str, int]]:
    """Path and size of the archives at ``path``: the one file, those that commits listed, or else all in the folder."""
    where, at = _place(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [f for f in where.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    lists = [f for f in inside if f.base_name.startswith("_files-")]
    if not lists:
        return sorted((f.path, f.size) for f in inside if f.base_name.endswith((".warc", ".warc.gz")))
    out = []
    for f in lists:
        with where.open_input_stream(f.path) as src:
            out += [(f"{at}/{line[1]}", int(line[0])) for line in (x.split("\t", 1) for x in src.read().decode().splitlines())]
    return sorted(out)


def _holds(f, value) -> bool:
    """Whether a pushed filter holds for a header's value (None: absent); a comparison with an absent one doesn't."""
    if isinstance(f, Not):
        return value is not None and not _holds(f.child, value) or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) and not _holds(f.child, value)
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    tests = {EqualTo: lambda: value == f.value, In: lambda: value in f.value, GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value, LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value, StringStartsWith: lambda: value.startswith(f.value), StringEndsWith: lambda: value.endswith(f.value), StringContains: lambda: f.value in value}
    return tests[type(f)]()


SIMPLE = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def _pushable(f) -> bool:
    inner = f.child if isinstance(f, Not) else f
    if not isinstance(inner, SIMPLE) or len(inner.attribute) != 1 or inner.attribute[0] not in HEADERS | HEADER_NUMBERS:
        return False
    values = inner.value if isinstance(inner, In) else (getattr(inner, "value", None),)
    return not (None in values and isinstance(inner, In)) and all(v is None or isinstance(v, (str, int)) for v in values)


class _Plain:
    """Records one after another in a file that can be read and skipped."""

    def __init__(self, src, size: int):
        self.src, self.size, self.at = src, size, 0

    def start(self) -> bool:
        return self.at < self.size

    def line(self) -> bytes:
        out = self.src.readline()
        self.at += len(out)
        return out

    def read(self, n: int) -> bytes:
        out = self.src.read(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        self.src.seek(self.at)

    def end(self) -> None:
        pass


class _Members:
    """The same over gzip members. A member that tells its length holds one record and isn't inflated beyond what is read; others may hold many."""

    def __init__(self, src, size: int):
        self.src, self.size, self.at = src, size, 0
        self.box, self.left, self.next, self.rest = None, b"", None, b""

    def start(self) -> bool:
        while True:
            if self.box is not None:
                self.more(1)
                if self.left:
                    return True
                self.at = self.src.tell() - len(self.box.unused_data)
                self.box = None
            if self.at >= self.size:
                return False
            self.src.seek(self.at)
            head = self.src.read(24)
            self.next = self.at + struct.unpack("<I", head[16:20])[0] if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\0" else None
            self.box, self.left, self.rest = zlib.decompressobj(31), b"", head

    def more(self, least: int) -> None:
        while len(self.left) < least and not self.box.eof:
            data = self.box.unconsumed_tail or self.rest or self.src.read(1 << 16)
            self.rest = b""
            if not data:
                raise EOFError("a gzip member is cut short")
            self.left += self.box.decompress(data, max(least - len(self.left), 4096))

    def line(self) -> bytes:
        seen = 0
        while (i := self.left.find(b"\n", seen)) < 0:
            seen = len(self.left)
            self.more(seen + 4096)
            if len(self.left) == seen:
                break
        return self.read(i + 1 if i >= 0 else len(self.left))

    def read(self, n: int) -> bytes:
        self.more(n)
        out, self.left = self.left[:n], self.left[n:]
        return out

    def skip(self, n: int) -> None:
        while self.next is None and n:  # inflate, keep nothing
            self.more(min(n, 1 << 20))
            got = min(n, len(self.left))
            if not got:
                raise EOFError("a record is cut short")
            self.left, n = self.left[got:], n - got

    def end(self) -> None:
        if self.next is not None:
            self.at, self.box = self.next, None


def headers(src) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case; folded lines belong to the one before, the last of equal names stays."""
    out, last = {}, None
    while (line := src.line()).rstrip(b"\r\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            out[last := name.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def records(src, name: str, wanted: set[str], filters: list) -> Iterator[dict]:
    """Rows of one archive. A file that isn't WARC, or is cut short, raises with its name and place."""
    body = wanted & {*HTTP, *PAYLOAD}
    while src.start():
        at = src.at
        first = src.line()
        if not first.strip():  # the empty lines between records
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {at}")
        head = headers(src)
        length = _number(head.get("content-length"))
        if length is None:
            raise ValueError(f"{name}: the record at {at} doesn't tell its length")
        value = lambda c, head=head, length=length: length if c in HEADER_NUMBERS else head.get(HEADERS[c])
        keep = all(_holds(f, value((f.child if isinstance(f, Not) else f).attribute[0])) for f in filters)
        if not keep or not body:
            src.skip(length)
        if keep:
            row = {c: value(c) for c in wanted & {*HEADERS, *HEADER_NUMBERS}} | {"headers": head, "file": name, "offset": at}
            if body:
                block = src.read(length)
                if len(block) < length:
                    raise EOFError(f"{name}: the record at {at} is cut short")
                row |= _block(block, head, body)
            yield row
        src.end()


def _block(block: bytes, head: dict[str, str], wanted: set[str]) -> dict:
    """What a record's block says: HTTP status and length, and the payload (of HTTP what follows its headers, else all)."""
    payload, row = block, {}
    if head.get("content-type", "").lower().startswith("application/http"):
        src = _Plain(io.BytesIO(block), len(block))
        status = src.line().decode("utf-8", "replace").split(" ", 2)
        http = headers(src)
        row = {"http_status": _number(status[1].strip()) if len(status) > 1 and status[0].startswith("HTTP/") else None, "http_content_length": _number(http.get("content-length"))}
        payload = block[src.at :]
    if head.get("warc-type") != "revisit" and wanted & {*PAYLOAD}:
        row |= {"payload": payload, "payload_length": len(payload), "payload_sha1": base32_sha1(payload) if "payload_sha1" in wanted else None}
    return row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.filters = options["path"].rstrip("/"), schema, []
        self.pack = int(options.get("partitionBytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [], self.pack
        for path, n in list_files(self.path):
            if size + n > self.pack:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        where, _ = _place(self.path)
        arrow, names = to_arrow_schema(self.schema), set(self.schema.names)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([list(r["headers"].items()) if f.name == "headers" else r.get(f.name) for r in rows], f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for path in partition.paths if partition else ():
            n = where.get_file_info(path).size
            with where.open_input_file(path) as raw:
                magic = raw.read(2)
                raw.seek(0)
                src = _Members(raw, n) if magic == b"\x1f\x8b" else _Plain(raw if n == 0 else _buffered(raw), n)
                for row in records(src, path, names, self.filters):
                    rows.append(row if "payload" in names else {k: v for k, v in row.items() if k != "payload"})
                    size += len(row.get("payload") or b"") if "payload" in names else 0
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


def _buffered(raw) -> io.BufferedReader:
    return io.BufferedReader(raw, 1 << 16)


class WarcSource(DataSource):
    """Options: ``path``; reading: ``partitionBytes``; writing: ``compression`` (gzip, none), ``fileBytes``, ``date``.

    Any subset of the columns of ``SCHEMA`` can be read (``schema(...)``); leave out those of ``HTTP`` and ``PAYLOAD`` to
    skip all blocks. Revisits have no payload. Absent headers, and numbers that aren't, are null; an archive that is
    cut short or isn't WARC fails the read. Rows to write have columns of ``HEADERS``, ``payload`` and ``http_status``;
    a null payload is an empty one.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archives(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").options(**options).save(path)


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The records at ``path`` with the ``columns`` (names and types as in ``SCHEMA``)."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


# Pages


def first_payloads(pages: DataFrame, payload: Column, id_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(digest, size, original)`` of each payload of ``min_bytes`` or more on several rows: the largest id that has it."""
    keys = pages.select(F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"), F.col(f"`{id_col}`").alias("i"))
    return keys.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("i").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


#: Shared payloads (a hex digest and two longs each) are broadcast up to this number, else joined by a shuffle.
BROADCAST_PAYLOADS = 500_000
URN = "<urn:x-page:"


def _urn(i: Column) -> Column:
    return F.concat(F.lit(URN), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))


def _page(urn: Column) -> Column:
    return F.substring(urn, F.lit(len(URN) + 1), F.length(urn) - len(URN) - 1).try_cast("long")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` as rows to write: response, or revisit of the row with the same payload and the largest id.

    Null html is an empty payload, a null id smaller than any; rows that share a payload and its largest id are all
    responses. Payloads stay where they are read: only digests are shuffled.
    """
    payload, i = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8"), F.col(f"`{id_col}`").cast("long")
    shared = counted_side(cut(first_payloads(pages, payload, id_col, min_bytes)), BROADCAST_PAYLOADS)
    rows = pages.select(i.alias("i"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    again = F.col("original").isNotNull() & ~F.col("i").eqNullSafe(F.col("original"))
    return rows.join(shared, ["digest", "size"], "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _urn(F.col("i")).alias("record_id"), "target_uri", F.when(again, _urn(F.col("original"))).alias("refers_to"), "payload"
    )


def archive_digests(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Writes ``pages`` to archives in a new folder (default: under the shared checkpoint folder) and reads them back.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of each record. Responses are read with
    their payloads, which are measured and hashed again; of revisits only headers are. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    at = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(page_records(pages, **names), at)
    full = read_archives(spark, at, "record_type string, record_id string, payload_length long, payload_sha1 string").where("record_type = 'response'")
    slim = read_archives(spark, at, "record_type string, record_id string, http_content_length long, payload_digest string, refers_to string").where("record_type = 'revisit'")
    full = full.select(_page(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    slim = slim.select(_page(F.col("record_id")).alias("page_id"), F.col("http_content_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", _page(F.col("refers_to")).alias("refers_to"))
    return full.union(slim)


ORACLE = """
with p as (select page_id, coalesce(html, '') x, sha1(coalesce(html, '')) h, octet_length(encode(coalesce(html, ''))) n from pages),
g as (select h, n, max(page_id) original from p group by h, n)
select page_id, n payload_bytes, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4)) & 31), 1) for i in range(32)], 'string_agg', '') payload_digest,
  case when page_id = original then 'response' else 'revisit' end record_type, case when page_id <> original then original end refers_to from p join g using (h, n)
"""
