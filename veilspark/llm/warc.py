"""WARC archives as a Spark data source: ``format("warc")`` reads and writes.

Reading plans a partition a file (with the option ``split_bytes``, one for so many bytes of a gzip file), takes predicates
on record type, target and record id before any payload is inflated, parses each record's headers first and seeks past
the records that no predicate wants. Members of other writers may hold several records and don't tell their length; what
no predicate wants is inflated piece by piece there and not kept. Writing puts one gzip member a record, its length in the
member's header (an extra field, ignored by other readers). Every commit lists the files of its successful tasks in a
manifest of its own; readers take the union, so files of lost or repeated attempts are never read. A failed write removes
its files; an overwrite removes what was listed before.

Null payloads are empty payloads; null urls are left out of the record; repeated pages are written each; an empty
table gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import join_per_key, written

WRITE_SCHEMA = "page_id long, url string, payload binary, record_type string, refers_to long"
READ_SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"
#: Names of manifests begin so.
MANIFEST = "_manifest"
#: A file ends after so many bytes, so one task can't make an archive that only one task can read.
ROLL_BYTES = 256 << 20
#: Records in a batch, and bytes after which a batch ends early.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTHS = struct.Struct("<2sHII")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length and the data's in an extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 12 + _LENGTHS.size + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", _LENGTHS.size) + _LENGTHS.pack(b"SL", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes | None  # None: skipped

    def http(self) -> tuple[dict[str, str], bytes]:
        """(headers, payload) of a block that holds an HTTP message; of any other, the block is the payload."""
        if not self.headers.get("content-type", "application/http").startswith("application/http"):
            return {}, self.block or b""
        head, _, payload = (self.block or b"").partition(b"\r\n\r\n")
        return _headers(head), payload


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(file, want=lambda headers: True, start: int = 0, end: int | None = None) -> Iterator[Record]:
    """Records of a seekable archive: gzip members (with or without lengths) or plain. ``want`` sees headers only.
    With ``start`` and ``end``, those of the gzip members that begin between them."""
    size = file.size()
    end = size if end is None else min(end, size)
    at = _member_from(file, start, end) if start else 0
    while at < end:
        file.seek(at)
        first = file.read(12)
        if first[:2] != b"\x1f\x8b":
            yield from _plain(file, at, size, want)
            return
        length, skip = None, 10
        if first[3] & 4:
            extra = file.read(struct.unpack("<H", first[10:12])[0])
            skip = 12 + len(extra)
            if len(extra) == _LENGTHS.size and extra[:2] == b"SL":
                length = _LENGTHS.unpack(extra)[2]
        if length is None:
            at = yield from _unsized(file, at, want)
            continue
        inflate, data = zlib.decompressobj(-15), b""
        left = length - skip - 8
        while b"\r\n\r\n" not in data and left > 0:
            chunk = file.read(min(4096, left))
            left -= len(chunk)
            data += inflate.decompress(chunk)
        head, _, body = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        if want(headers):
            body += inflate.decompress(file.read(left)) + inflate.flush()
            yield Record(headers, body[: int(headers["content-length"])])
        at += length


def _member_from(file, at: int, end: int) -> int:
    """The first place from ``at`` on where a gzip member begins that holds records; ``end`` if there is none."""
    magic, overlap = b"\x1f\x8b\x08", 2
    while at < end:
        file.seek(at)
        data = file.read(1 << 20)
        found = data.find(magic)
        while found >= 0 and at + found < end:
            file.seek(at + found)
            try:
                if zlib.decompressobj(31).decompress(file.read(4096), 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass  # bytes of a payload that look like a member's first ones
            found = data.find(magic, found + 1)
        at += max(len(data) - overlap, 1)
    return end


class _Inflated:
    """The data of one gzip member of unknown length, inflated piece by piece."""

    def __init__(self, file, at: int):
        file.seek(at)
        self.file, self.at, self.inflate, self.data = file, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflates further; false at the member's end."""
        if self.inflate.eof:
            return False
        chunk = self.inflate.unconsumed_tail
        if not chunk:
            chunk = self.file.read(1 << 16)
            self.at += len(chunk)
        out = self.inflate.decompress(chunk, 1 << 20)
        if not chunk and not out and not self.inflate.eof:
            raise EOFError("the archive ends inside a gzip member")
        self.data += out
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What precedes the mark, which is passed; None if the data end before."""
        seen = 0
        while (found := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                return None
        out, self.data = self.data[:found], self.data[found + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes | None:
        parts, left = [], n
        while left:
            if not self.data and not self.more():
                raise EOFError("a record is shorter than its Content-Length")
            part, self.data = self.data[:left], self.data[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts) if keep else None

    def end(self) -> int:
        return self.at - len(self.inflate.unused_data)


def _unsized(file, at: int, want) -> Iterator[Record]:
    """All records of a member of another writer, which is inflated to find its end; returns that."""
    member = _Inflated(file, at)
    while (head := member.until(b"\r\n\r\n")) is not None:
        # Records end with two line ends, which stand before the next one's head.
        headers = _headers(head.lstrip(b"\r\n"))
        if "content-length" not in headers:
            continue
        wanted = want(headers)
        block = member.take(int(headers["content-length"]), wanted)
        if wanted:
            yield Record(headers, block)
    return member.end()


def _plain(file, at: int, size: int, want) -> Iterator[Record]:
    while at < size:
        file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            chunk = file.read(4096)
            if not chunk:
                return
            head += chunk
        head = head.partition(b"\r\n\r\n")[0]
        headers = _headers(head)
        body, length = at + len(head) + 4, int(headers["content-length"])
        if want(headers):
            file.seek(body)
            yield Record(headers, file.read(length))
        at = body + length + 4


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


@dataclass
class _File(InputPartition):
    path: str
    start: int = 0
    end: int | None = None

    def __init__(self, path: str, start: int = 0, end: int | None = None):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


@dataclass
class _Done(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


#: Column: the header that holds it.
_PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload, self.verify = options["path"], options.get("payload", "true") == "true", options.get("verify", "true") == "true"
        self.split = int(options.get("split_bytes", 0))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo) and name in _PUSHED:
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In) and name in _PUSHED:
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and name in _PUSHED:
                self.tests.append((name, "starts", (f.value,)))
            elif isinstance(f, IsNotNull) and name in _PUSHED:
                self.tests.append((name, "there", ()))
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        sizes = {i.path: i.size for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File}
        names = listed(store, sizes)
        found = []
        for name in sorted(n for n in (sizes if names is None else names) if n.endswith((".warc", ".warc.gz"))):
            step = self.split if self.split and name.endswith(".gz") else None
            found += [_File(name, at, at + step) for at in range(0, sizes[name], step)] if step else [_File(name)]
        return found or [_File("")]

    def _want(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            value = headers.get(_PUSHED[name])
            if value is None or (how == "in" and value not in values) or (how == "starts" and not value.startswith(values[0])):
                return False
        return True

    def read(self, partition: _File):
        if not partition.path:
            return
        names = [*READ_SCHEMA.replace(" string", "").replace(" long", "").split(", "), *(["payload"] if self.payload else [])]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows: list[tuple] = []
        held = 0
        store, _ = fs.FileSystem.from_uri(self.path)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        with store.open_input_file(partition.path) as file:
            for r in records(file, self._want, partition.start, partition.end):
                http, payload = r.http()
                kind, told = r.headers.get("warc-type"), r.headers.get("warc-payload-digest") or ""
                told = told.removeprefix("sha1:") if told.startswith("sha1:") else ""
                if kind == "revisit":
                    size, payload = int(http.get("content-length", 0)), None
                else:
                    size = len(payload)
                    if self.verify and told and payload_digest(payload) != told:
                        raise ValueError(f"payload digest differs: {r.headers.get('warc-record-id')} in {partition.path}")
                row = (r.headers.get("warc-record-id"), kind, r.headers.get("warc-target-uri"), _page(r.headers.get("warc-record-id")), _page(r.headers.get("warc-refers-to")), size, told or None)
                rows.append((*row, payload) if self.payload else row)
                held += len(payload or b"") if self.payload else 0
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.level, self.roll, self.overwrite = options["path"], int(options.get("level", 3)), int(options.get("roll_bytes", ROLL_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done, out = _Done([]), None
        try:
            for batch in iterator:
                for page_id, url, payload, kind, refers_to in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, sent = store.open_output_stream(f"{root}/{name}", compression=None), 0
                        done.files.append(name)
                    data = member(record(page_id, url, payload or b"", kind, refers_to), self.level)
                    out.write(data)
                    sent += len(data)
                    if sent >= self.roll:
                        out.close()
                        out = None
            if out is not None:
                out.close()
        except BaseException:  # a task that fails leaves no files
            if out is not None:
                out.close()
            self._removed(done.files)
            raise
        return done

    def _removed(self, names: list[str]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in names:
            try:
                store.delete_file(f"{root}/{name}")
            except FileNotFoundError:
                pass  # removed before

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        before = [i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File] if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.files)).encode())
        if self.overwrite:
            manifests = [n for n in before if n.rsplit("/", 1)[-1].startswith(MANIFEST)]
            gone = listed(store, before)
            # Manifests go first: a reader sees files that are there.
            self._removed([n.removeprefix(f"{root}/") for n in [*manifests, *(gone if gone is not None else before)]])

    def abort(self, messages):
        self._removed([n for m in messages if m for n in m.files])


def listed(store: fs.FileSystem, names) -> list[str] | None:
    """The files that the manifests among ``names`` list; None where there is no manifest (other writers' archives)."""
    manifests = [n for n in names if n.rsplit("/", 1)[-1].startswith(MANIFEST)]
    files = set()
    for manifest in manifests:
        with store.open_input_stream(manifest) as f:
            files |= {f"{manifest.rsplit('/', 1)[0]}/{n}" for n in json.loads(f.read())}
    return sorted(files) if manifests else None


class WarcSource(DataSource):
    """Options: path; payload (true: with the payload column); verify (true: digests are recomputed); split_bytes (reading, 0: files
    are whole; set it for large archives whose payloads don't hold archives themselves); level, roll_bytes (writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA + (", payload binary" if self.options.get("payload", "true") == "true" else "")

    def reader(self, schema: StructType):
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows to write: of equal payloads of at least ``least_bytes``, the largest id (all rows that have it) is the response
    and the others revisit it. A null id refers to the largest id or, without one, is a response."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least_bytes, F.unhex(F.sha1("payload"))))
    groups = rows.filter("sha is not null").groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    known = join_per_key(rows, written(groups, "warc-groups"), ["sha"], "n", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archive(rows: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).options(**options).save(path)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
