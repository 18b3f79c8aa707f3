"""WARC files as a Spark data source.

``df.write.format("warc")`` writes one gzip member a record, files of about
``file_bytes``; each member's gzip header carries its own length (the ``sl``
field), so a reader can pass over it without inflating it.  A manifest names
the files of the tasks that were committed, so a repeated or failed attempt
leaves nothing that is read.

``spark.read.format("warc")`` plans partitions from the manifest (or from the
listing of a folder or file of someone else's, ``.warc`` or ``.warc.gz``) by
size.  Predicates on the header columns are pushed into the scan: a record's
WARC header is inflated and parsed first, then the HTTP header if a predicate
asks for it, and only a record that is wanted has its payload inflated, unless
``option("payload", "false")``.

Columns of a record: see ``SCHEMA``; ``payload`` is the body of the HTTP message,
or the whole block of a record that is none; a revisit has none (NULL), but
``payload_length`` (from its HTTP header) and ``payload_sha1`` (of its WARC
header) are those of the full payload.

Pages (``write_pages``, ``read_pages``): of pages with equal payloads of at
least ``MIN_REVISIT`` bytes that with the largest page_id is the response and
the others revisit it.  A NULL html is an empty payload, a NULL url gives no
target.  Among equal payloads, all rows that carry the largest id are
responses; a NULL id revisits; if all ids are NULL, all are responses.  An empty
table gives an empty archive.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from driftmark.llm.common import ready
from driftmark.llm.tokenbin import _fs

SCHEMA = ("record_id string, record_type string, date string, target_uri string, content_type string, "
          "content_length long, payload_digest string, payload_sha1 string, refers_to string, "
          "payload_length long, headers map<string,string>, payload binary")
#: Columns known from the WARC header, and from the HTTP header after it.
FROM_WARC = ("record_id", "record_type", "date", "target_uri", "content_type", "content_length",
             "payload_digest", "payload_sha1", "refers_to")
FROM_HTTP = ("payload_length",)
#: Columns of a frame that is written.
WRITTEN = "record_id string, record_type string, date string, target_uri string, refers_to string, payload_length long, payload_sha1 string, payload binary"
# Fixed values of the format (ISO 28500).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.jsonl"
MIN_REVISIT = 1000
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES, BATCH_ROWS, FIRST = 1 << 26, 1 << 26, 1 << 23, 1024, 1 << 12


# --- records ------------------------------------------------------------------


def _clean(value: str) -> str:
    """Header text: control characters and blanks as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def render(r: dict) -> bytes:
    """A response or revisit with its HTTP header.  A revisit carries no body."""
    body = r["payload"] or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_length']}\r\n\r\n").encode()
    block = http + (body if r["record_type"] == "response" else b"")
    lines = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
    if r["target_uri"] is not None:
        lines.append(("WARC-Target-URI", _clean(r["target_uri"])))
    lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["payload_sha1"])).decode()))
    if r["record_type"] == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["refers_to"])]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines), b"", block, b"", b""])


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that says how long it is, packed and unpacked."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 0, 0)
    size = 10 + 2 + len(extra) + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >> 32:  # does not fit the field
        return struct.pack("<2sBBIBB", b"\x1f\x8b", 8, 0, 0, 0, 255) + body + tail
    return (struct.pack("<2sBBIBBH", b"\x1f\x8b", 8, 4, 0, 0, 255, len(extra))
            + struct.pack("<2sHII", b"sl", 8, size, len(data)) + body + tail)


def _member_size(head: bytes) -> int | None:
    """The length of the member that begins with ``head``, if it says so."""
    if len(head) < 12 or not head[3] & 4:
        return None
    end, at = 12 + int.from_bytes(head[10:12], "little"), 12
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2:at + 4], "little")
        if head[at:at + 2] == b"sl" and n == 8:
            return int.from_bytes(head[at + 4:at + 8], "little")
        at += 4 + n
    return None


class _Stored:
    """The bytes of an uncompressed record, read as far as asked."""

    def __init__(self, f, at: int):
        self.f, self.at, self.buf = f, at, b""

    def upto(self, n: int) -> bytes:
        if n > len(self.buf):
            self.f.seek(self.at + len(self.buf))
            self.buf += self.f.read(n - len(self.buf))
        return self.buf

    def end(self, length: int) -> int:
        return self.at + length


class _Member:
    """The bytes of a gzip member, inflated as far as asked."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at
        f.seek(at)
        head = f.read(FIRST)
        self.size = _member_size(head)
        self.inflate = zlib.decompressobj(31)
        self.rest, self.fed, self.parts, self.have = head, len(head), [], 0

    def _more(self, n: int) -> None:
        if not self.rest:
            self.f.seek(self.at + self.fed)
            self.rest = self.f.read(1 << 16)
            self.fed += len(self.rest)
            if not self.rest:
                raise ValueError(f"gzip member at {self.at} is cut off")
        got = self.inflate.decompress(self.rest, max(n, 1))
        self.rest = self.inflate.unconsumed_tail
        self.parts.append(got)
        self.have += len(got)

    def upto(self, n: int) -> bytes:
        while self.have < n and not self.inflate.eof:
            self._more(n - self.have)
        self.parts = [b"".join(self.parts)]
        return self.parts[0]

    def end(self, length: int) -> int:
        if self.size:
            return self.at + self.size
        while not self.inflate.eof:
            self._more(1 << 20)
            self.parts, self.have = [], 0
        return self.at + self.fed - len(self.rest) - len(self.inflate.unused_data)


def _until_blank(src, start: int) -> int:
    """Where the header that begins at ``start`` ends, after its blank line;
    -1 if there is none."""
    n = start + 512
    while True:
        buf = src.upto(n)
        i = buf.find(b"\r\n\r\n", start)
        if i >= 0:
            return i + 4
        if len(buf) < n:
            return -1
        n *= 2


def parse_header(raw: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _whole(value: str | None) -> int | None:
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


def _sha1(digest: str | None) -> str | None:
    """A labelled digest as bare hex; Base 32 is the usual spelling."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if len(value) == 40 else None


def records(f, size: int, wanted=lambda row, keys: True, payload: bool = True) -> Iterator[tuple]:
    """The records of an open file as rows of ``SCHEMA``.  ``wanted(row, keys)``
    judges by the columns ``keys``; what it refuses is not inflated further."""
    at = 0
    while at < size:
        f.seek(at)
        magic = f.read(2)
        if magic == b"\r\n":  # between stored records
            at += 2
            continue
        src = (_Member if magic == b"\x1f\x8b" else _Stored)(f, at)
        body = _until_blank(src, 0)
        head = src.upto(body)[:body]
        if body < 0 or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        h = parse_header(head)
        length = _whole(h.get("content-length"))
        if length is None:
            raise ValueError(f"the record at {at} has no Content-Length")
        kind = h.get("warc-type")
        row = {"record_id": h.get("warc-record-id"), "record_type": kind, "date": h.get("warc-date"),
               "target_uri": h.get("warc-target-uri"), "content_type": h.get("content-type"), "content_length": length,
               "payload_digest": h.get("warc-payload-digest"), "payload_sha1": _sha1(h.get("warc-payload-digest")),
               "refers_to": h.get("warc-refers-to")}
        if wanted(row, FROM_WARC):
            start, stop, own = body, body + length, {}
            if (h.get("content-type") or "").startswith("application/http"):
                start = _until_blank(src, body)
                start = stop if start < 0 or start > stop else start
                own = parse_header(src.upto(start)[body:start])
            row["payload_length"] = _whole(own.get("content-length")) if kind == "revisit" else stop - start
            if wanted(row, FROM_HTTP):
                data = None
                if payload and kind != "revisit":
                    data = src.upto(stop)[start:stop]
                    if len(data) != stop - start:
                        raise ValueError(f"the record at {at} is cut off")
                yield (*(row[c] for c in FROM_WARC), row["payload_length"], h, data)
        at = src.end(body + length)


# --- predicates ---------------------------------------------------------------

_COMPARE = {
    ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v, ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
}


def column_of(f: ds.Filter) -> str | None:
    """The header column a predicate asks about; None if it is not ours."""
    if isinstance(f, ds.Not):
        return column_of(f.child)
    if not isinstance(f, (*_COMPARE, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or len(f.attribute) != 1:
        return None
    if isinstance(f, ds.In) and None in f.value:  # unknown, not false, for what is not in it
        return None
    return f.attribute[0] if f.attribute[0] in (*FROM_WARC, *FROM_HTTP) else None


def holds(f: ds.Filter, row: dict) -> bool | None:
    """A predicate as SQL has it: None where it is unknown."""
    if isinstance(f, ds.Not):
        got = holds(f.child, row)
        return None if got is None else not got
    x = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    return None if x is None or getattr(f, "value", None) is None else _COMPARE[type(f)](x, f.value)


# --- data source --------------------------------------------------------------


@dataclass
class Files(ds.InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int, int]]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            if column_of(f):
                self.filters.append(f)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs as pafs
        fs, p = _fs(self.path)
        if fs.get_file_info(p).type == pafs.FileType.File:
            return [(p, fs.get_file_info(p).size)]
        if fs.get_file_info(f"{p}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{p}/{MANIFEST}") as f:
                return [(f"{p}/{n}", size) for n, size, _ in map(json.loads, f.read().splitlines())]
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
        return [(i.path, i.size) for i in found if re.search(r"\.warc(\.gz)?$", i.path) and i.size]

    def partitions(self) -> list[Files]:
        """Files side by side up to ``split_bytes``; the largest first."""
        out, room = [], 0
        for path, size in sorted(self.files(), key=lambda x: (-x[1], x[0])):
            if not out or room < size:
                out.append(Files())
                room = self.split
            out[-1].files.append((path, size))
            room -= size
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds.get(t, pa.map_(pa.string(), pa.string()))) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])
        judged = {keys: [f for f in self.filters if column_of(f) in keys] for keys in (FROM_WARC, FROM_HTTP)}

        def wanted(row: dict, keys: tuple) -> bool:
            return all(holds(f, row) for f in judged[keys])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                              schema=schema)

        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                for *cols, headers, data in records(f, size, wanted, self.payload):
                    rows.append((*cols, list(headers.items()), data))
                    held += len(data or b"") + 1024
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, p = _fs(self.path)
        fs.create_dir(p)
        done, out, name, size, n = [], None, "", 0, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{p}/{name}", compression=None)
                data = member(render(r))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= self.file_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, p = _fs(self.path)
        fs.create_dir(p)
        manifest, lines = f"{p}/{MANIFEST}", []
        if not self.overwrite and fs.get_file_info(manifest).is_file:
            with fs.open_input_stream(manifest) as f:
                lines = f.read().decode().splitlines()
        lines += [json.dumps(x) for m in messages if m for x in m.files]
        with fs.open_output_stream(f"{manifest}.new") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        fs.move(f"{manifest}.new", manifest)

    def abort(self, messages: list[Written | None]) -> None:
        fs, p = _fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                fs.delete_file(f"{p}/{name}")


class Warc(ds.DataSource):
    """Options: ``path``; reading: ``payload`` (false: never inflate one),
    ``split_bytes``; writing: ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """The format ``warc``, with predicates pushed into it."""
    ready(spark)
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(spark: SparkSession, path: str, where: str | None = None, payload: bool = True) -> DataFrame:
    """The records of an archive that satisfy ``where``, loaded anew: in Spark
    4.1 a loaded frame keeps the predicates that were last pushed into it, and
    a later query of the same frame that pushes none would miss rows."""
    register(spark)
    df = spark.read.format("warc").option("payload", str(payload).lower()).load(path)
    return df.where(where) if where else df


# --- pages --------------------------------------------------------------------


def page_records(pages: DataFrame, date: str) -> DataFrame:
    """A record of every page, in the columns of ``WRITTEN``.  Pages meet by
    digest and length; only digests that occur again travel to the pages, so
    the payloads stay where they are unless there are very many of those."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.alias("payload"))
    one = one.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_sha1", F.sha1("payload"))
    again = (one.where(F.col("payload_length") >= MIN_REVISIT).groupBy("payload_sha1", "payload_length")
             .agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").drop("n"))
    urn = (lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">")))
    later = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return (one.join(again, ["payload_sha1", "payload_length"], "left")
            .select(urn("page_id").alias("record_id"), F.when(later, "revisit").otherwise("response").alias("record_type"),
                    F.lit(date).alias("date"), "target_uri", F.when(later, urn("owner")).alias("refers_to"), "payload_length",
                    "payload_sha1", F.when(~later, F.col("payload")).alias("payload")))


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    register(pages.sparkSession)
    page_records(pages, date).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as the
    archives have it: of responses measured on the payload, of revisits (a
    scan that inflates no payload) taken from the headers."""
    page = (lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long"))
    full = archive(spark, path, "record_type = 'response'")
    bare = archive(spark, path, "record_type = 'revisit'", payload=False)
    kinds = [(full, F.octet_length("payload").cast("long"), F.sha1("payload")), (bare, F.col("payload_length"), F.col("payload_sha1"))]
    a, b = (df.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
                      "record_type", page("refers_to").alias("refers_to")) for df, size, digest in kinds)
    return a.unionByName(b)
