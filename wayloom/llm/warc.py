"""WARC: a Python data source that reads and writes archives, for plain and gzip files.

Reading plans partitions of whole files (small files share one), pushes predicates on record_type,
record_id, target_uri and refers_to down to the scan, parses a record's headers first and passes over
the payload of a record that a predicate rejects: by a seek in plain files, unread in gzip members.
Files are opened through pyarrow's file systems, so any store that those know will do.

Writing makes a file for each partition. A task writes under a name of its own; the commit puts the
files of successful tasks in place, so that retried and lost tasks leave nothing behind.

`archive` turns pages into records and `pages_of` turns records back. Of records with equal payloads
of at least `least` bytes the one with the largest page_id is a response, the others revisit it.
Null html is an empty payload; a null url gives no WARC-Target-URI and comes back null; a null page_id
counts as smaller than any; repeated rows of the largest page_id are all responses. Extra columns are
left out. No pages give an empty archive, which reads as no rows. Payloads are written and read whole, however long
(a batch is handed on at 4 MB, a longer record alone). A file that is cut off inside a record is an error, also where
the payload is passed over. Jobs that write to one path don't disturb each other.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from wayloom.llm.common import new_path, ship, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
_HEADERS = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}
_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
_URNS = ("record_id", "refers_to")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if ":" not in path.split("/", 1)[0]:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class Plain:
    """Reads ahead in an uncompressed file; skip() seeks."""

    chunk = 1 << 18

    def __init__(self, file):
        self.file, self.held, self.end = file, b"", False

    def more(self) -> bool:
        got = self.file.read(self.chunk)
        self.held += got
        self.end = not got
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is taken too; None at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.file.read(n - len(self.held))
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            raise EOFError("a record ends before its Content-Length")
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held))
        self.held = self.held[inside:]
        if n > inside:
            to = self.file.tell() + n - inside
            if to > self.file.size():
                raise EOFError("a record ends before its Content-Length")
            self.file.seek(to)


class Gzip(Plain):
    """The same over gzip members; skip() drops bytes as they are inflated."""

    def __init__(self, file):
        super().__init__(file)
        self.z, self.raw = zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.file.read(self.chunk)
            if not self.raw:
                self.end = True
                return False
            got, self.raw = self.z.decompress(self.raw), b""
            if got:
                self.held += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            raise EOFError("a record ends before its Content-Length")
        return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.more():
                raise EOFError("a record ends before its Content-Length")
        self.held = self.held[n:]


def headers(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower()] = v.strip()
    return out


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, pack_bytes: int):
        self.path, self.payload, self.pack_bytes = path, payload, pack_bytes
        self.equal: list[tuple[str, frozenset[str]]] = []
        self.prefix: list[tuple[str, str]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):
        for x in filters:
            column = getattr(x, "attribute", (None,))
            name = column[0] if len(column) == 1 and column[0] in _HEADERS else None
            if name and isinstance(x, EqualTo) and isinstance(x.value, str):
                self.equal.append((name, frozenset([x.value])))
            elif name and isinstance(x, In) and all(isinstance(v, str) for v in x.value):
                self.equal.append((name, frozenset(x.value)))
            elif name and isinstance(x, StringStartsWith):
                self.prefix.append((name, x.value))
            elif name and isinstance(x, IsNotNull):
                self.present.append(name)
            else:
                yield x

    def partitions(self):
        fs, root = filesystem(self.path)
        infos = [fs.get_file_info(root)] if fs.get_file_info(root).type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in infos if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root) :])
        packs: list[list[str]] = []
        size = self.pack_bytes + 1
        for path, n in files:
            if size + n > self.pack_bytes:
                packs.append([])
                size = 0
            packs[-1].append(path)
            size += n
        return [Files(x) for x in packs] or [Files([])]

    def wanted(self, row: dict) -> bool:
        return all(row[k] in v for k, v in self.equal) and all((row[k] or "").startswith(v) and row[k] is not None for k, v in self.prefix) and all(row[k] is not None for k in self.present)

    def records(self, path: str, fs) -> Iterator[dict]:
        with fs.open_input_file(path) as file:
            source = Gzip(file) if path.endswith(".gz") else Plain(file)
            while (head := source.until(b"\r\n\r\n")) is not None:
                h = headers(head.lstrip(b"\r\n"))
                row = {k: h[v].decode() if v in h else None for k, v in _HEADERS.items()}
                for k in _URNS:
                    row[k] = row[k].strip("<>") if row[k] else None
                n = int(h[b"content-length"])
                if not self.wanted(row) or not self.payload:
                    source.skip(n + 4)
                    if self.wanted(row):
                        yield row | {"payload": None, "payload_length": int(h[b"warc-payload-length"]) if b"warc-payload-length" in h else None}
                    continue
                block = source.take(n)
                source.skip(4)
                payload = block.partition(b"\r\n\r\n")[2] if h.get(b"content-type", b"").startswith(b"application/http") else block
                told = h.get(b"warc-payload-length")
                yield row | {"payload": payload, "payload_length": int(told) if told else len(payload)}

    def read(self, partition):
        fs, _ = filesystem(self.path)
        held, size = [], 0
        for path in partition.paths:
            for row in self.records(path, fs):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


def record(row: dict) -> bytes:
    """The bytes of a record; line breaks in header values are escaped."""
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row["payload_length"] or 0) if row["record_type"] in ("response", "revisit") else b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date'] or '1970-01-01T00:00:00Z'}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    if row["payload_digest"] is not None:
        lines += [f"WARC-Payload-Digest: {row['payload_digest']}", f"WARC-Payload-Length: {row['payload_length']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, gzip: bool):
        self.path, self.gzip, self.tasks = path, gzip, f"_tasks-{uuid.uuid4().hex}"  # a folder for each job: jobs that write to one path leave each other's alone

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{self.tasks}", recursive=True)
        name = f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}"
        pack = (lambda x: (z := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(x) + z.flush()) if self.gzip else (lambda x: x)
        with fs.open_output_stream(f"{root}/{self.tasks}/{name}", compression=None, buffer_size=1 << 20) as out:
            out.write(pack(record({"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "date": None, "target_uri": None, "payload_digest": None, "payload": b"format: WARC File Format 1.1\r\n", "payload_length": 29})))
            for batch in iterator:
                for i in range(batch.num_rows):
                    out.write(pack(record({k: batch.column(k)[i].as_py() for k in _ARROW.names})))
        return Written(name)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        for x in messages:
            if x is not None:
                fs.move(f"{root}/{self.tasks}/{x.name}", f"{root}/{x.name}")
        if fs.get_file_info(f"{root}/{self.tasks}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.tasks}")

    def abort(self, messages):
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.tasks}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.tasks}")


class WarcDataSource(DataSource):
    """format("warc"): options path, payload (true), pack_bytes (reading), compression (none or gzip, writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("pack_bytes", 8 << 20)))

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], self.options.get("compression", "none") == "gzip")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, least: int = 1000, compression: str = "none", broadcast_groups: int = 100_000) -> None:
    """Writes one record for each row of pages. Groups of equal payloads are found on their digests; the texts aren't shuffled while the groups are few."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_length", F.length("payload").cast("long")).withColumn("same", F.when(F.col("payload_length") >= least, F.unhex(F.sha2("payload", 256))))
    groups = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = groups.persist()
    small = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    found = rows.join(F.broadcast(groups) if small else groups, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    sha1 = F.udf(lambda x: "sha1:" + base64.b32encode(bytes.fromhex(x)).decode(), "string", useArrow=True)
    out = found.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        sha1(F.sha1("payload")).alias("payload_digest"),
        "payload_length",
        F.when(revisit, urn("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", path).option("compression", compression).save()
    groups.unpersist()


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of an archive; a response's digest is that of the payload read."""
    register(spark)
    records = spark.read.format("warc").option("path", path).load().filter(F.col("record_type").isin("response", "revisit"))
    told = F.udf(lambda x: base64.b32decode(x.removeprefix("sha1:")).hex() if x else None, "string", useArrow=True)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(revisit, told("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
        "payload",
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op1-warc")
    archive(table(spark, sf_dir, "pages"), path)
    return pages_of(spark, path).drop("url", "payload")


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


OP1_SQL = r"""
WITH a AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM a)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM g
"""
