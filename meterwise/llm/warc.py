"""WARC archives as a Spark data source: spark.read.format("warc") and df.write.format("warc").

Reading plans file partitions, takes filters on record type and other headers from Spark, parses a record's headers
first, and passes over the payload of a record that isn't wanted. Each record is a gzip member of its own whose extra
field "sl" holds its length, as the WARC standard's annex on compression describes, so passing over is a seek; records
of other writers, without it, are decompressed and discarded; in uncompressed files Content-Length serves.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..operators.joins import join_spread
from .common import shared_dir, stored

#: The columns that come from the headers; filters on them are pushed down.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "content_type", "content_length", "payload_digest", "refers_to", "http_status", "payload_length")
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, http_status int, payload_length long, computed_digest string, payload binary, file string, offset long"
ARROW = pa.schema([(c, pa.string()) for c in HEADER_COLUMNS[:5]] + [("content_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("http_status", pa.int32()), ("payload_length", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: Manifests that are read at once.
READERS = 16
_MANIFEST = "_manifest-"


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- reading


class _Member:
    """One record's bytes from `at` on, decompressed as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at = file, at
        file.seek(at)
        self.raw = file.read(CHUNK)
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.length = None  # of the gzip member, if it says so
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.data, self.pending, self.read = b"", self.raw, len(self.raw)
        if self.gzip and len(self.raw) > 12 and self.raw[3] & 4:
            extra = self.raw[12 : 12 + int.from_bytes(self.raw[10:12], "little")]
            while len(extra) >= 4:
                size = int.from_bytes(extra[2:4], "little")
                if extra[:2] == b"sl" and size >= 8:
                    self.length = int.from_bytes(extra[4:8], "little")
                extra = extra[4 + size :]

    def _more(self, most: int) -> bytes:
        while True:
            if self.inflate is None:
                piece, self.pending = self.pending[:most], self.pending[most:]
            elif self.inflate.eof:
                return b""
            else:
                piece = self.inflate.decompress(self.pending, most)
                self.pending = self.inflate.unconsumed_tail or self.inflate.unused_data
            if piece or (self.inflate is not None and self.inflate.eof):
                return piece
            if not self.pending:
                self.pending = self.file.read(CHUNK)
                self.read += len(self.pending)
                if not self.pending:
                    return b""

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed too; None at the end."""
        while mark not in self.data:
            piece = self._more(4096)
            if not piece:
                return None
            self.data += piece
        found, _, self.data = self.data.partition(mark)
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.data[:n]], len(self.data[:n])
        self.data = self.data[n:]
        while have < n and (piece := self._more(min(n - have, 1 << 20))):
            parts.append(piece)
            have += len(piece)
        return b"".join(parts)

    def end(self, left: int) -> int:
        """Where the next record begins; `left` bytes of this one's block have not been taken."""
        if not self.gzip:
            return self.at + self.read - len(self.pending) - len(self.data) + left + 4
        if self.length:
            return self.at + self.length
        while self._more(CHUNK):
            pass
        return self.at + self.read - len(self.pending)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def records(file: pa.NativeFile, name: str, wanted: Callable[[dict], bool], payloads: str) -> Iterator[dict]:
    """The wanted records of one archive. payloads: decode, digest (decode, but give the digest only) or skip."""
    at, size = 0, file.size()
    while at < size:
        member = _Member(file, at)
        head = member.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record at byte {at}")
        warc = _fields(head)
        length = left = _number(warc.get("content-length")) or 0
        kind = warc.get("content-type", "")
        http: dict[str, str] = {}
        status = None
        if kind.startswith("application/http") and length:
            block = member.until(b"\r\n\r\n")
            if block is not None:
                left -= len(block) + 4
                http, parts = _fields(block), block.split(b"\r\n", 1)[0].split()
                status = _number(parts[1].decode("ascii", "replace")) if len(parts) > 1 and parts[0].startswith(b"HTTP/") else None
        record = {
            "record_id": warc.get("warc-record-id"), "record_type": warc.get("warc-type"), "target_uri": warc.get("warc-target-uri"), "date": warc.get("warc-date"), "content_type": kind or None, "content_length": length,
            "payload_digest": (warc.get("warc-payload-digest") or "").rpartition(":")[2] or None, "refers_to": warc.get("warc-refers-to"), "http_status": status, "payload_length": _number(http.get("content-length")) if http else left,
            "computed_digest": None, "payload": None, "file": name, "offset": at,
        }
        if wanted(record):
            if payloads != "skip" and warc.get("warc-type") != "revisit":
                payload = member.take(left)
                left -= len(payload)
                record["computed_digest"] = digest(payload)
                record["payload"] = payload if payloads == "decode" else None
            yield record
        at = member.end(left)


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a, IsNotNull: lambda a, _: True,
}


def _pushable(f: Filter) -> bool:
    inner = f.child if isinstance(f, Not) else f
    return type(inner) in _TESTS and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_COLUMNS


def _holds(f: Filter, record: dict) -> bool:
    """As in SQL, a comparison with null doesn't hold, nor does its negation, but for IS NULL."""
    inner = f.child if isinstance(f, Not) else f
    value = record[inner.attribute[0]]
    if value is None:
        return isinstance(f, Not) and isinstance(inner, IsNotNull)
    return _TESTS[type(inner)](value, getattr(inner, "value", None)) != isinstance(f, Not)


@dataclass
class WarcPartition(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "decode")
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.filters: list[Filter] = []
        if self.payloads not in ("decode", "digest", "skip"):
            raise ValueError("payload is decode, digest or skip")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        """Files are planned in groups of about partitionBytes. With manifests, only files that a finished write lists."""
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(root)
        if found.type == arrow_fs.FileType.File:
            return [WarcPartition((root,))]
        inside = [x for x in where.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if x.is_file]
        manifests = [m for m in inside if m.base_name.startswith(_MANIFEST)]
        with ThreadPoolExecutor(READERS) as pool:
            texts = list(pool.map(lambda m: where.open_input_file(m.path).read(), manifests))
        listed = {f"{m.path.rpartition('/')[0]}/{name}" for m, text in zip(manifests, texts, strict=True) for name in json.loads(text)}
        files = [x for x in inside if (x.path in listed if manifests else x.base_name.endswith((".warc", ".warc.gz")))]
        groups: list[list[str]] = []
        room = 0
        for x in sorted(files, key=lambda x: x.path):
            if not groups or x.size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(x.path)
            room -= x.size
        return [WarcPartition(tuple(g)) for g in groups] or [WarcPartition(())]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        where, _ = arrow_fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.files:
            with where.open_input_file(name) as file:
                for r in records(file, name, lambda r: all(_holds(f, r) for f in self.filters), self.payloads):
                    rows.append(r)
                    held += 500 + len(r["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


# ---- writing


def record_bytes(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member with its compressed and plain length in the extra field "sl"."""
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    plain = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    size = 12 + 12 + len(body) + 8
    if size >= 1 << 32:
        raise ValueError("a record of over 4 GB compressed")
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _line(text: str) -> str:
    return " ".join(text.split())


def page_record(r: dict) -> bytes:
    """The record of one row: record_id, target_uri, date, record_type, refers_to, payload (none in a revisit), payload_length, payload_digest."""
    revisit = r["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_length']}\r\n\r\n".encode()
    headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"])]
    if r["target_uri"]:
        headers.append(("WARC-Target-URI", _line(r["target_uri"])))
    headers += [("WARC-Date", r["date"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["refers_to"])]
    return record_bytes(headers, http if revisit else http + (r["payload"] or b""))


@dataclass
class WarcFiles(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; only those of tasks that Spark commits come into the manifest."""

    def __init__(self, options: dict):
        self.path, self.file_bytes = options["path"], int(options.get("fileBytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFiles:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        names: list[str] = []
        out, room = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                data = page_record(batch.slice(i, 1).to_pylist()[0])
                if out is None or room < len(data):
                    if out is not None:
                        out.close()
                    names.append(f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
                    out, room = where.open_output_stream(f"{root}/{names[-1]}", compression=None), self.file_bytes
                out.write(data)
                room -= len(data)
        if out is not None:
            out.close()
        return WarcFiles(tuple(names))

    def commit(self, messages: list[WarcFiles | None]) -> None:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[WarcFiles | None]) -> None:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; for reading payload (decode, digest, skip) and partitionBytes; for writing fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages


def record_id(key) -> F.Column:
    return F.format_string("<urn:page:%s>", key.cast("string"))


def page_key(id_column) -> F.Column:
    """The number in a record id that record_id has made; null for none."""
    return F.regexp_extract(id_column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def write_pages(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row of pages to WARC files under path.

    The payload is the html in UTF-8; null counts as empty. Of rows with equal payloads of `least` bytes or more, that
    with the smallest id is a response and the others are revisits that refer to it; smaller payloads are all responses.
    Rows that repeat both the smallest id and the payload are all responses; a null id is after all others, and rows
    are all responses in a group without ids. Payloads count as equal by SHA-1 and length. Payloads of any length are
    written whole; of an empty table nothing is. Other columns are ignored.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("long").alias("payload_length"))
    # groups are found and joined without payloads; these move by record at most, and not at all where few are revisits
    digests = stored(rows.where(F.col("payload_length") >= least).select("key", "sha", "payload_length"), "payloads")
    groups = digests.groupBy("sha", "payload_length").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    copies = join_spread(digests, groups, ["sha", "payload_length"], "n", digests.count()).where("NOT (key <=> first)").distinct()
    revisits = stored(copies.select(F.col("sha").alias("r_sha"), F.col("payload_length").alias("r_length"), F.col("key").alias("r_key"), "first"), "revisits")
    same = (F.col("sha") == F.col("r_sha")) & (F.col("payload_length") == F.col("r_length")) & F.col("key").eqNullSafe(F.col("r_key"))
    revisit = F.col("first").isNotNull()
    out = rows.join(revisits, same, "left").select(
        record_id(F.coalesce(F.col("key").cast("string"), F.lit("none"))).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, record_id(F.col("first"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_length",
        base32("sha").alias("payload_digest"),
    )
    out.write.format("warc").mode("append").option("path", path).save()


def base32(sha) -> F.Column:
    """A 20-byte digest in base 32, by regrouping its 160 bits into 32 letters."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(F.hex(sha), i, 8), 16, 2), 32, "0") for i in range(1, 41, 8)))
    letters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.array_join(letters, "")


def read_warc(spark: SparkSession, path: str, payload: str = "decode") -> DataFrame:
    """The records under path, with the columns of SCHEMA. payload: decode, digest (computed_digest only) or skip."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def archived_pages(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses give the digest of the payload as it was read; revisits, whose payloads aren't stored, that of their headers.
    Payloads of any length are archived whole, an empty table gives no rows, and repeated rows, ties and nulls are as in
    write_pages.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/meterwise/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, least)
    full = read_warc(spark, path, "digest").where("record_type = 'response'").withColumn("digest", F.col("computed_digest"))
    brief = read_warc(spark, path, "skip").where("record_type = 'revisit'").withColumn("digest", F.col("payload_digest"))
    return full.unionByName(brief).select(page_key(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page_key(F.col("refers_to")).alias("refers_to"))
