"""WARC archives as a PySpark Python data source (``spark.read.format("warc")`` and ``df.write.format("warc")``).

Reading: every archive file is planned as one partition. Record types and header values
asked for travel to the tasks as options of the load (``read_archives(..., record_type=...)``).
A task parses a record's headers first. A record that the predicates reject, or whose
payload no column asks for, is skipped undecoded: by a seek in plain files, and by the member
length that the writer leaves in the gzip extra field in compressed ones (members of other
writers are inflated and dropped).

The predicates are options and not Spark's own pushed filters because Spark keeps the reader
and what was pushed to it with the load: a second query on the same load would be answered
with the first one's predicates. Filters on a load are left to Spark and always hold.

Writing: each task writes one file of gzip members, one a record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .common import text_or_empty

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, page_id bigint, payload_bytes bigint, payload binary"
# Header fields. The last two are extensions, which readers of WARC pass over.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "X-Page-ID", "payload_bytes": "X-Payload-Length"}
PUSHED = ("record_type", "page_id", "target_uri", "payload_digest", "record_id", "refers_to")
CHUNK = 1 << 16
#: Bytes of a member before its deflated data: the gzip header and the extra field.
LEAD = 24


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def member(record: bytes) -> bytes:
    """A gzip member whose extra field "WL" holds the member's own length (64 bits)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = LEAD + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"WL", 8, length) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(head: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_archive(stream: io.RawIOBase, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the records that ``wanted`` (of the headers) accepts, plain or gzipped. Every byte is inflated once at most."""
    stream = io.BufferedReader(stream, CHUNK)
    while True:
        start = stream.tell()
        lead = stream.read(LEAD)
        if not lead.strip():
            return
        if lead[:2] != b"\x1f\x8b":
            stream.seek(start)
            yield from _plain(stream, wanted, with_payload)
            return
        known = lead[3] & 4 and lead[12:16] == b"WL\x08\0"
        stream.seek(start)
        inflate, text, fed = zlib.decompressobj(31), bytearray(), 0

        def more() -> bool:
            nonlocal fed
            block = stream.read(CHUNK)  # noqa: B023
            fed += len(block)
            text.extend(inflate.decompress(block))  # noqa: B023
            return bool(block)

        end, seen = -1, 0
        while (end := text.find(b"\r\n\r\n", max(0, seen - 3))) < 0 and not inflate.eof:
            seen = len(text)
            if not more():
                break
        head = parse_head(bytes(text[:end]))
        take = wanted(head)
        if take and with_payload:
            while not inflate.eof and more():
                pass
            yield head, bytes(memoryview(text)[end + 4 : end + 4 + int(head.get("content-length", 0))])
        elif take:
            yield head, None
        if known:
            stream.seek(start + struct.unpack("<Q", lead[16:24])[0])
            continue
        text = bytearray()
        while not inflate.eof and more():
            text.clear()
        stream.seek(start + fed - len(inflate.unused_data))


def _plain(stream: io.BufferedReader, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while True:
        lines = [stream.readline()]
        while lines[-1] in (b"\r\n", b"\n"):
            lines = [stream.readline()]
        if not lines[-1]:
            return
        while lines[-1] not in (b"\r\n", b"\n", b""):
            lines.append(stream.readline())
        head = parse_head(b"".join(lines))
        size = int(head.get("content-length", 0))
        take = wanted(head)
        if take and with_payload:
            yield head, stream.read(size)
        else:
            stream.seek(size, io.SEEK_CUR)
            if take:
                yield head, None


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.columns, self.path = [f.name for f in schema.fields], options["path"]
        self.accepted = {c: set(json.loads(options[f"only.{c}"])) for c in PUSHED if f"only.{c}" in options}

    def partitions(self):
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [ArchiveFile(p) for p in files] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile):
        if not partition.path:
            return
        wanted = lambda head: all(_value(head, c) is not None and str(_value(head, c)) in v for c, v in self.accepted.items())
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as stream:
            for head, payload in read_archive(stream, wanted, "payload" in self.columns):
                yield tuple(payload if c == "payload" else _value(head, c) for c in self.columns)


def _value(head: dict[str, str], column: str):
    value = head.get(FIELDS[column].lower())
    if value is None:
        return None
    return int(value) if column in ("page_id", "payload_bytes") else value.removeprefix("sha1:") if column == "payload_digest" else value


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceWriter):
    """Files get their names when the job commits, so those of failed attempts are never read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
            for row in rows:
                payload = bytes(row["payload"] or b"")
                digest = row["payload_digest"] or base64.b32encode(hashlib.sha1(payload).digest()).decode()
                size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
                values = {c: row[c] for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "page_id")} | {"payload_digest": f"sha1:{digest}", "payload_bytes": size}
                head = {FIELDS[c]: " ".join(str(values[c]).split()) for c in FIELDS if values[c] is not None}
                out.write(member(record(head, payload)))
                n += 1
        return Written(name, n)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{root}/{m.name}.tmp", f"{root}/{m.name}")

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}.tmp")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def record_id(page: Column) -> Column:
    """A stable URN of a page id."""
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def base32(hexed: Column) -> Column:
    """Base32 of 40 hex digits (a SHA-1), upper case, no padding."""
    digit = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(F.conv(F.substring(hexed, 5 * i // 4 + 1, 2), 16, 10).cast("int"), 3 - i % 4).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(i) for i in range(32)])


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """WARC rows (SCHEMA) of pages: of equal payloads the row of largest id is a response, the others are revisits without payload.

    Payloads under ``least_bytes`` are all responses. A null payload counts as empty. Null
    ids and repeats of the largest id are responses of their own. Payloads are grouped by
    SHA-256 before they are joined, so only digests and ids are grouped, summed where read.
    """
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(uri_col).alias("target_uri"), text_or_empty(payload_col).alias("_text"))
    key = F.sha2("_text", 256)
    groups = base.groupBy(key.alias("_key")).agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key", "_best")
    joined = base.withColumn("_k", key).join(groups, F.col("_k") == F.col("_key"), "left")
    revisit = (F.col("_best") != F.col("page_id")) & (F.octet_length("_text") >= least_bytes)
    revisit = F.coalesce(revisit, F.lit(False))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        base32(F.sha1("_text")).alias("payload_digest"),
        F.when(revisit, record_id(F.col("_best"))).alias("refers_to"),
        "page_id",
        F.octet_length("_text").cast("bigint").alias("payload_bytes"),
        F.when(~revisit, F.encode("_text", "UTF-8")).alias("payload"),
    )


def write_archives(spark: SparkSession, pages: DataFrame, path: str, **kw) -> None:
    register(spark)
    records(pages, **kw).write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA, **only) -> DataFrame:
    """Records under a folder; give fewer columns (a schema string) and payloads that none of them needs stay undecoded.

    Keywords (record_type, page_id, target_uri, payload_digest, record_id, refers_to) give a
    value or a list of them that a record's header must have; all others are skipped on their
    headers. A record without the header has none of the values.
    """
    register(spark)
    load = spark.read.format("warc").schema(columns).option("path", path)
    for column, values in only.items():
        if column not in PUSHED:
            raise ValueError(f"no predicate on {column!r}; there are {', '.join(PUSHED)}")
        load = load.option(f"only.{column}", json.dumps([str(v) for v in (values if isinstance(values, list | tuple | set) else [values])]))
    return load.load()


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    Responses are read with their payload, of which size and digest are taken anew. Of
    revisits only headers are read, which give the size and digest of the payload they refer
    to.
    """
    heads = SCHEMA.replace(", payload binary", "")
    of = lambda kind, columns=heads: read_archives(spark, path, columns, record_type=kind)
    responses = of("response", SCHEMA).select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    targets = of("response").select(F.col("record_id").alias("_rid"), F.col("page_id").alias("_target")).dropDuplicates(["_rid"])
    revisits = of("revisit").join(targets, F.col("refers_to") == F.col("_rid"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_target").alias("refers_to"))
    return responses.unionByName(revisits)
