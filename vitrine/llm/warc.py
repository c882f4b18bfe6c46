"""WARC archives as a **PySpark Python data source**.

``spark.read.format("warc").load(folder)`` plans partitions over the archives' byte
ranges, and reads record by record: the header block is parsed first, pushed-down
predicates on it are tested, and the block of a record that fails, or whose payload is
not among the columns asked for, is skipped without being decoded. Pass the columns
with ``.schema(...)``; filters are pushed down where
``spark.sql.python.filterPushdown.enabled`` is set (see ``read_warc``).

``df.write.format("warc").save(folder)`` writes one archive per task attempt under a
name of its own. Only the driver's commit, which gets the names of the attempts that
counted, writes the manifest that readers go by, so files of lost, repeated or
speculative tasks are never read. The manifest also holds record offsets every
``SPLIT_BYTES``, at which large archives are split. Records are gzip members that tell their own
length, so a record is passed over without inflating it. Archives from elsewhere (no
manifest) are read one per partition, plain or gzip.

Folders are reached through pyarrow's file systems (local, hdfs, s3, gcs), since the
readers and writers run as plain Python in tasks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

MANIFEST = "_manifest.json"
SPLIT_BYTES = 32 << 20
#: Records are handed to the archive in pieces of this size.
CHUNK = 1 << 20
#: Read of a gzip member before its header is parsed.
HEAD_BYTES = 1 << 12
GZIP_LEVEL = 4
VERSION = b"WARC/1.0"

#: Column and the header field that it comes from.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
          "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile",
          "payload_length": "X-Payload-Length"}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS if c != "payload_length") + ", payload_length long, http string, payload binary"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Archives made here carry no time of their own, so that equal input gives equal bytes.
DATE = "1970-01-01T00:00:00Z"


def file_system(path: str):
    """pyarrow file system and path of a folder or file name, with or without a scheme."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:/", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(row: dict) -> Iterator[bytes]:
    """The bytes of one record; a null payload is empty, null header fields are left out."""
    payload = row.get("payload") or b""
    http = (row.get("http") or "").encode()
    head = [VERSION]
    for column, field in FIELDS.items():
        if row.get(column) is not None:
            head.append(f"{field}: {clean(str(row[column]))}".encode())
    if http:
        head.append(b"Content-Type: application/http; msgtype=response")
    head.append(b"Content-Length: %d" % (len(http) + len(payload)))
    yield b"\r\n".join(head) + b"\r\n\r\n" + http
    for k in range(0, len(payload), CHUNK):
        yield payload[k:k + CHUNK]
    yield b"\r\n\r\n"


@dataclass
class Archive(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, gzip: bool):
        self.path, self.overwrite, self.gzip = path, overwrite, gzip

    def write(self, rows) -> Archive:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        name, at, splits = f"part-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}", 0, [0]
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for row in rows:
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                pieces = record(row.asDict())
                for piece in [member(pieces)] if self.gzip else pieces:
                    out.write(piece)
                    at += len(piece)
        return Archive(name, at, splits)

    def commit(self, messages) -> None:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        entries = [] if self.overwrite else manifest(self.path) or []
        entries += [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.size]
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(entries).encode())

    def abort(self, messages) -> None:
        fs, folder = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.name}")


def manifest(path: str) -> list[dict] | None:
    fs, folder = file_system(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type.name != "File":
        return None
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def parse_head(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined, the first of a repeated field counts."""
    out: dict[str, str] = {}
    name = None
    for line in lines.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            a, _, v = line.partition(b":")
            key = a.strip().decode("latin-1").lower()
            name = None if key in out else key
            out.setdefault(key, v.strip().decode("utf-8", "replace"))
    return out


class _Plain:
    """Buffered reading of an uncompressed archive with skipping."""

    def __init__(self, f, at: int):
        self.f, self.buffer, self.at = f, b"", at
        f.seek(at)

    def head(self) -> bytes | None:
        """The next header block without its empty line, None at the end."""
        while True:
            k = self.buffer.find(b"\r\n\r\n")
            if k >= 0:
                out = self.buffer[:k]
                self._drop(k + 4)
                return out
            more = self.f.read(CHUNK)
            if not more:
                return None
            self.buffer += more

    def _drop(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def take(self, n: int) -> bytes:
        parts, need = [self.buffer[:n]], n - len(self.buffer)
        self._drop(min(n, len(self.buffer)))
        if need > 0:
            parts.append(self.f.read(need))
            self.at += need
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self._drop(n)
        else:
            self.at += n
            self.buffer = b""
            self.f.seek(self.at)


def member(pieces: Iterator[bytes]) -> bytes:
    """One gzip member whose extra field ``SL`` holds its own length, so that readers
    can pass over a record without inflating it. Other gzip readers ignore the field."""
    z, crc, size, body = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, -15), 0, 0, []
    for p in pieces:
        crc, size = zlib.crc32(p, crc), size + len(p)
        body.append(z.compress(p))
    body.append(z.flush())
    length = 10 + 2 + 12 + sum(map(len, body)) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, length)
    return b"".join([head, *body, struct.pack("<II", crc, size & 0xFFFFFFFF)])


def member_length(start: bytes) -> int | None:
    """The length that a gzip member tells of itself, if it does."""
    if len(start) < 24 or start[:3] != b"\x1f\x8b\x08" or not start[3] & 4:
        return None
    extra, name, size = struct.unpack_from("<H2sH", start, 10)
    return struct.unpack_from("<Q", start, 16)[0] if extra >= 12 and name == b"SL" and size == 8 else None


class _Members:
    """Records that are members which tell their length: a header is inflated as far as
    it goes, the rest of the record only if it is taken."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def head(self) -> bytes | None:
        self.f.seek(self.at)
        raw = self.f.read(HEAD_BYTES)
        if not raw:
            return None
        length = member_length(raw)
        if length is None:
            raise ValueError(f"no gzip member of known length at byte {self.at}")
        self.left, self.end = length - len(raw[:length]), self.at + length
        self.z = zlib.decompressobj(31)
        self.buffer = self.z.decompress(raw[:length])
        while b"\r\n\r\n" not in self.buffer and self._more():
            pass
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        return head

    def _more(self) -> bool:
        raw = self.f.read(min(self.left, CHUNK))
        self.left -= len(raw)
        self.buffer += self.z.decompress(raw)
        return bool(raw)

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and self.left:
            raw = self.f.read(min(self.left, CHUNK))
            if not raw:
                break
            self.left -= len(raw)
            parts.append(self.z.decompress(raw))
            have += len(parts[-1])
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        self.at = self.end  # whatever is left of the record


class _Gzip(_Plain):
    """The same over gzip members; skipped blocks are inflated, in pieces, and dropped."""

    class _Stream:
        def __init__(self, f):
            self.f, self.z, self.rest = f, zlib.decompressobj(31), b""

        def read(self, n: int) -> bytes:
            out = b""
            while len(out) < n:
                data = self.rest or self.f.read(CHUNK)
                if not data:
                    break
                out += self.z.decompress(data, n - len(out))
                self.rest = self.z.unconsumed_tail
                if self.z.eof:
                    self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            return out

        def seek(self, at: int) -> None:
            pass

    def __init__(self, f):
        super().__init__(self._Stream(f), 0)

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.take(min(n, CHUNK))) or n


class WarcReader(DataSourceReader):
    """``filters`` holds, per header column, the tests a record must pass."""

    def __init__(self, path: str, columns: list[str], split_bytes: int):
        self.path, self.columns, self.split_bytes, self.filters = path, columns, split_bytes, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", ())
            known = len(column) == 1 and column[0] in FIELDS and column[0] != "payload_length"
            if known and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.filters.append(f)
            else:
                yield f  # Spark tests it

    def partitions(self):
        fs, folder = file_system(self.path)
        entries = manifest(self.path)
        if entries is None:
            from pyarrow.fs import FileSelector

            info = fs.get_file_info(folder)
            files = [info] if info.type.name == "File" else [x for x in fs.get_file_info(FileSelector(folder, recursive=True)) if x.is_file]
            return [Range(f.path, 0, f.size) for f in sorted(files, key=lambda f: f.path) if re.search(r"\.warc(\.gz)?$", f.path) and f.size]
        out = []
        for e in entries:
            keep = e["splits"][:1]
            for s in e["splits"][1:]:
                if s - keep[-1] >= self.split_bytes:
                    keep.append(s)
            out += [Range(f"{folder}/{e['name']}", a, b) for a, b in zip(keep, [*keep[1:], e["size"]])]
        return out

    def _passes(self, head: dict[str, str]) -> bool:
        for f in self.filters:
            v = head.get(FIELDS[f.attribute[0]].lower())
            if isinstance(f, IsNotNull):
                ok = v is not None
            elif isinstance(f, EqualTo):
                ok = v == f.value
            elif isinstance(f, In):
                ok = v in f.value
            else:
                ok = v is not None and v.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Range):
        if partition is None:  # no archives
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            packed = partition.path.endswith(".gz")
            known = packed and member_length(f.read(24)) is not None
            f.seek(0)
            stream = _Members(f, partition.start) if known else _Gzip(f) if packed else _Plain(f, partition.start)
            while isinstance(stream, _Gzip) or stream.at < partition.end:
                raw = stream.head()
                if raw is None:
                    return
                raw = raw.lstrip(b"\r\n")
                if not raw.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record before byte {stream.at} of {partition.path}")
                head = parse_head(raw)
                length = int(head.get("content-length", 0))
                if not self._passes(head):
                    stream.skip(length + 4)
                    continue
                http = payload = None
                is_http = head.get("content-type", "").startswith("application/http")
                if "payload" in self.columns or "http" in self.columns:
                    payload = stream.take(length)
                    stream.skip(4)
                    if is_http:
                        top, mark, body = payload.partition(b"\r\n\r\n")
                        http, payload = (top + mark).decode("utf-8", "replace"), body
                else:
                    stream.skip(length + 4)
                size = head.get("x-payload-length")
                values = {c: head.get(FIELDS[c].lower()) for c in FIELDS} | {
                    "payload_length": int(size) if size is not None and size.isdigit() else None, "http": http, "payload": payload}
                yield tuple(values[c] for c in self.columns)


class WarcDataSource(DataSource):
    """Options: ``path``; ``splitBytes``, the least bytes of a partition of a split
    archive; ``compression``, ``gzip`` (a member per record) or ``none``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, self.options.get("compression", "gzip") == "gzip")


def register(spark: SparkSession) -> None:
    from vitrine.llm.common import ship

    ship(spark)
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The records under ``path``; ``columns`` leaves out what need not be decoded.
    Turns on the session's push-down of filters to Python data sources."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    types = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
    return spark.read.format("warc").schema(schema).load(path)


#: Smaller payloads are stored again rather than referred to.
REVISIT_BYTES = 100
URN = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One WARC record per page. Of pages with equal payloads of ``revisit_bytes`` or
    more, the one with the smallest id is a ``response`` and the others are
    ``revisit`` records without a payload that refer to it; smaller ones are all responses.

    A null or empty payload is an empty response; a null address is left out. Rows of
    a repeated id are all the response if their id is the smallest. Rows without an
    id get a record that nothing refers to. Other columns are not read.
    """
    from vitrine.llm.common import with_group

    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    # an exact copy costs a digest, not its payload, in this shuffle
    first = rows.where(F.col("length") >= revisit_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    rows = with_group(rows, first, "digest", F.col("id"))
    again = F.coalesce(F.col("id") != F.col("first"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("length").cast("string"), F.lit("\r\n\r\n"))
    return rows.select(
        F.concat(F.lit(f"<{URN}"), F.col("id").cast("string"), F.lit(">")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, F.concat(F.lit(f"<{URN}"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(again, REVISIT).alias("profile"), F.col("length").alias("payload_length"), http.alias("http"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("compression", compression).mode("append").save(path)
