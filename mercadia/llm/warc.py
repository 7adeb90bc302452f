"""WARC archives as a Spark data source: a writer of gzip members, a reader that plans files, filters on headers and decodes
only wanted payloads."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from mercadia.llm.common import materialize, shared_dir, table

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns by header. What has no column of its own is in the map of all headers.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, headers map<string,string>, http_headers map<string,string>, payload binary, file string, offset long"
#: Bytes of payload in one batch of rows, and of input read at once.
_BATCH, _READ = 8 << 20, 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- reading ----


@dataclass
class Files(InputPartition):
    """Files that one task reads, one after the other."""

    paths: list[str]


class _Members:
    """The bytes of an archive, gzip members or plain, unpacked a piece at a time. What is skipped is never kept."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.width = source, b"", 0
        self.raw = source.read(2)
        self.packed, self.inflate, self.begin = self.raw == b"\x1f\x8b", None, 0

    def _more(self) -> bytes:
        """The next piece; nothing at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.source.read(_READ)
                if not self.raw:
                    if self.inflate is not None:
                        raise ValueError("the archive ends within a gzip member")
                    return b""
            if not self.packed:
                out, self.raw = self.raw, b""
                return out
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
                self.begin = self.source.tell() - len(self.raw)
            out = self.inflate.decompress(self.raw, _READ)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if out:
                return out

    def line(self) -> bytes | None:
        """The next line without its end, whose bytes are counted in width; None at the end of the file."""
        while (end := self.buffer.find(b"\n")) < 0:
            more = self._more()
            if not more:
                break
            self.buffer += more
        end = end + 1 or len(self.buffer)
        out, self.buffer, self.width = self.buffer[:end], self.buffer[end:], end
        return out.rstrip(b"\r\n") if out else None

    def place(self) -> int:
        """Where the line just read begins: in a plain archive its place, else that of its member."""
        return self.begin if self.packed else self.source.tell() - len(self.raw) - len(self.buffer) - self.width

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.buffer:
                self.buffer = self._more()
                if not self.buffer:
                    raise ValueError("the archive ends within a record")
            parts.append(self.buffer[:left])
            self.buffer = self.buffer[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Drop n bytes: a plain archive is read on behind them, a member is unpacked without being kept."""
        here = min(n, len(self.buffer))
        self.buffer, n = self.buffer[here:], n - here
        if n and not self.packed:
            here = min(n, len(self.raw))
            self.raw, n = self.raw[here:], n - here
            if n:
                self.source.seek(self.source.tell() + n)
            return
        while n:
            piece = self._more()
            if not piece:
                raise ValueError("the archive ends within a record")
            self.buffer, n = piece[n:], n - min(n, len(piece))


def _fields(next_line) -> dict[str, str]:
    """Named fields up to the empty line; a line that begins with white space goes on the one before."""
    out: dict[str, str] = {}
    name = None
    while line := next_line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip()
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _get(fields: dict[str, str], name: str) -> str | None:
    """A field by its name in any case."""
    if name in fields:
        return fields[name]
    return next((v for k, v in fields.items() if k.lower() == name.lower()), None)


def _is_http(content_type: str | None) -> bool:
    return (content_type or "").replace(" ", "").lower().startswith("application/http")


def records(source, wanted=lambda fields: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], dict[str, str] | None, bytes | None, int]]:
    """(fields, HTTP fields, payload, offset) of each wanted record of an open archive. The fields of a record are read
    first; what follows them is passed over unless the record is wanted, and its payload unless payloads are."""
    data = _Members(source)
    while True:
        line = data.line()
        while line == b"":
            line = data.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        offset, fields = data.place(), _fields(data.line)
        left = int(_get(fields, "Content-Length") or 0)
        if not wanted(fields):
            data.skip(left)
            continue
        http = None
        if _is_http(_get(fields, "Content-Type")):
            read = 0

            def line_of_block():
                nonlocal read
                if read >= left:
                    return None
                before = data.line()
                if before is None:
                    raise ValueError("the archive ends within a record")
                read += data.width
                return before

            status = line_of_block()
            http = _fields(line_of_block) | {":status": (status or b"").decode("utf-8", "replace")}
            left -= read
        payload = None
        if payloads:
            payload = data.take(left)
        else:
            data.skip(left)
        yield fields, http, payload, offset


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path") or ""
        self.bytes = int(options.get("partitionbytes", 128 << 20))
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.tests: list = []

    def pushFilters(self, filters):
        """Takes the tests of columns that are headers; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", ("",))[0] in HEADERS and len(f.attribute) == 1 and isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith | StringEndsWith | StringContains):
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        """Archives in the order of their names, packed into partitions of about partitionbytes; a larger one is a partition."""
        at, path = _open(self.path)
        found = at.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else at.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", ".")) and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        prefix = self.path.partition("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        packed, size = [], 0
        for f in files:
            if not packed or size + f.size > self.bytes:
                packed.append(Files([]))
                size = 0
            packed[-1].paths.append(prefix + f.path)
            size += f.size
        return packed or [Files([])]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for f in self.tests:
            v = _get(fields, HEADERS[f.attribute[0]])
            if isinstance(f, IsNull):
                fine = v is None
            elif isinstance(f, IsNotNull):
                fine = v is not None
            elif isinstance(f, EqualNullSafe):
                fine = v == f.value
            elif v is None:
                fine = False
            elif isinstance(f, EqualTo):
                fine = v == f.value
            elif isinstance(f, In):
                fine = v in f.value
            elif isinstance(f, StringStartsWith):
                fine = v.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                fine = v.endswith(f.value)
            else:
                fine = f.value in v
            if not fine:
                return False
        return True

    def read(self, partition):
        rows, size = [], 0
        for path in partition.paths:
            at, name = _open(path)
            with at.open_input_file(name) as source:
                for fields, http, payload, offset in records(source, self._wanted, self.payloads):
                    rows.append((*(_get(fields, h) for h in HEADERS.values()), int(_get(fields, "Content-Length") or 0), list(fields.items()), list(http.items()) if http is not None else None, payload, path, offset))
                    size += len(payload or b"") + 1024
                    if size >= _BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, fields = pa.string(), pa.map_(pa.string(), pa.string())
    schema = pa.schema([*((c, text) for c in HEADERS), ("content_length", pa.int64()), ("headers", fields), ("http_headers", fields), ("payload", pa.binary()), ("file", text), ("offset", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def _clean(value: str) -> str:
    """A header's value on one line: control characters as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record: the version, its fields without those that are None, the block."""
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in fields.items() if v is not None), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def _http(payload_length: int, content_type: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {payload_length}\r\n\r\n".encode()


class _Writer(DataSourceArrowWriter):
    """Each task writes hidden files of about rollbytes; the driver gives them their names when all tasks have ended, so a
    task that is run again, or a job that fails, leaves nothing that a reader sees."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options.get("path") or "", overwrite
        self.roll = int(options.get("rollbytes", 256 << 20))
        self.level = int(options.get("level", 6))
        self.mime = options.get("payloadtype", "text/html; charset=UTF-8")
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator):
        at, folder = _open(self.path)
        at.create_dir(folder, recursive=True)
        context = TaskContext.get()
        stem = f"{self.run}-{context.partitionId():06d}-{context.taskAttemptId()}"
        done, out = [], None
        for batch in iterator:
            columns = {c.lower(): batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                if out is None or out.tell() >= self.roll:
                    if out is not None:
                        out.close()
                    done.append(f"{folder}/.{stem}-{len(done):04d}.warc.gz")
                    out = at.open_output_stream(done[-1], compression=None)
                    out.write(self._member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                r = {c: x[k].as_py() for c, x in columns.items()}
                payload = r.get("payload") or b""
                revisit = r["record_type"] == "revisit"
                fields = {h: r.get(c) for c, h in HEADERS.items() if c != "content_type"} | {"Content-Type": "application/http; msgtype=response"}
                if revisit:
                    fields["WARC-Profile"] = fields["WARC-Profile"] or IDENTICAL_PAYLOAD
                full = r.get("payload_length")
                out.write(self._member(fields, _http(len(payload) if full is None else full, self.mime) + (b"" if revisit else payload)))
        if out is not None:
            out.close()
        return Written(done)

    def _member(self, fields: dict[str, str | None], block: bytes) -> bytes:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return pack.compress(record_bytes(fields, block)) + pack.flush()

    def commit(self, messages) -> None:
        at, folder = _open(self.path)
        at.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in at.get_file_info(fs.FileSelector(folder)):
                if f.is_file and f.base_name.endswith(".warc.gz") and not f.base_name.startswith("."):
                    at.delete_file(f.path)
        for m in messages:
            for p in m.paths if m else ():
                head, _, name = p.rpartition("/")
                at.move(p, f"{head}/part-{name[1:]}")

    def abort(self, messages) -> None:
        at, folder = _open(self.path)
        for f in at.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                at.delete_file(f.path)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``.

    Reading: one row a record, with the columns of SCHEMA. Filters on record_type and the other header columns are
    tested on a record's headers, before its block is unpacked (spark.sql.python.filterPushdown.enabled must be true).
    Option payload=false leaves all payloads undecoded and null; partitionBytes packs files. HTTP headers are parsed
    apart, the status line under ``:status``; repeated fields are joined by commas. A file that breaks off raises.

    Writing: columns record_id, record_type, target_uri, date, payload_digest, refers_to, profile, payload and
    payload_length (of the full payload, for revisits, which hold no payload); a column that is missing or null gives no
    field. Files are rolled at rollBytes, each record is a gzip member of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def use_warc(spark: SparkSession) -> None:
    """Register the source and let Spark hand filters to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ----


def archive_pages(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record a row of pages (page_id, url, html) to path.

    The payload is html in UTF-8, null as empty. Of rows with equal payloads of at least ``least`` bytes that of least
    page_id is a response, the others are revisits that refer to it; all smaller ones are responses. The rows are
    written once with an id of their own; payloads travel once more, to the response of their digest. Record ids are
    urn:page:<page_id>:<row>.

    Null page_ids come last, repeated ones go by row; each row has a record. A null url gives no target URI. Extra
    columns are ignored; an empty table gives no record.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, compression="zstd")
    # a page id that is null is the last of all, its row the last of its like
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row")
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select(F.col("digest").alias("of"), "first")
    joined = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    out = joined.select(
        urn(F.col("page_id"), F.col("row")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, urn(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.col("bytes").alias("payload_length"),
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What archive_pages wrote, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri,
    payload (null for revisits). Digest and length of a response are taken from its payload, those of a revisit, which
    has none, from its headers; a payload that has another digest than its header raises."""
    use_warc(spark)
    found = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    told = F.regexp_replace("payload_digest", "^sha256:", "")
    own = F.sha2("payload", 256)
    response = F.col("record_type") == "response"
    checked = F.when(own == told, own).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in "), "record_id")))
    return found.select(
        page("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("http_headers")["Content-Length"].cast("int")).cast("long").alias("payload_bytes"),
        F.when(response, checked).otherwise(told).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "target_uri", F.when(response, F.col("payload")).alias("payload"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back. Edge cases as in archive_pages."""
    use_warc(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
