"""WARC archives with a two-level capture index.

Writing: pages with equal payloads are found by digest; the one with the largest page_id becomes a response record,
the others revisit records that point to it. Every task writes gzip members, one a record, to archives of its own,
whose names hold a random part: what a lost or repeated task wrote is not referred to by the entries that remain.

Index: entries are range-sorted by reversed-host URL key and page id. Every range becomes one file of compressed
blocks of entries, followed by its sparse directory, the first key and place of each block. The list of files by
first key, one row for each range, is all that the driver holds.

Reading: requests are sorted by the same key. A task bisects the list of files, then a file's directory, reads the
block's bytes alone, bisects its entries, and reads the record's bytes alone.

Defined cases: a null html is an empty payload; a null url has the empty key; rows with a null page id are archived
and refer to the response if their payload has one; among rows with the largest page id of a payload all are
responses; repeated rows are archived one by one and all returned; an empty table gives no archives and an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, new_dir, remove, small_batches

BLOCK_ENTRIES = 512
ARCHIVE_BYTES = 1 << 30


def url_key(url: str | None) -> str:
    """The host's labels in reverse, comma-joined, then ")" and path and query; lower case; scheme, user, port, fragment and leading www left out."""
    m = re.match(r"(?is)\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    host = re.sub(r"^www\d*\.", "", m[1].strip().lower().rstrip("."))
    return ",".join(reversed(host.split("."))) + ")" + (m[2].strip().lower() or "/") if host or m[2] else ""


def entry_key(url: str | None, page: int | None) -> str:
    return f"{url_key(url)} {'' if page is None else f'{page + (1 << 63):020d}'}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'none' if page is None else page}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, at: str, *, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = 0, level: int = 4) -> DataFrame:
    """Writes all pages and gives (key, file, offset, length), an entry for each record, materialised."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # materialised, so that a digest with a large part of the pages does not keep the join from being split
    same = cut(rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1 and response is not null").select("digest", "response"))
    enough = F.octet_length("payload") >= revisit_bytes
    rows = rows.join(same, "digest", "left").select("page_id", "url", "payload", F.when(enough & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(at)
        fs.create_dir(root, recursive=True)
        out, name, size = None, "", 0
        for b in batches:
            entries = []
            for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, payload, refers, date)) + packer.flush()
                out.write(member)
                entries.append({"key": entry_key(url, page), "file": name, "offset": size, "length": len(member)})
                size += len(member)
            if entries:
                yield pa.RecordBatch.from_pylist(entries, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, "key string, file string, offset long, length long"))


def write_index(entries: DataFrame, at: str, *, block_entries: int = BLOCK_ENTRIES) -> list[tuple[str, str, int, int]]:
    """Writes the index and gives (first key, file, directory's offset, directory's length) of its files, by key: a row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(at)
        name, out, size, directory, held = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush() -> None:
            nonlocal out, size
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            block = zlib.compress("\n".join(held).encode())
            out.write(block)
            directory.append([json.loads(held[0])[0], size, len(block)])
            size += len(block)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(json.dumps(row))
                if len(held) == block_entries:
                    flush()
        if held:
            flush()
        if out is not None:
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "file": name, "offset": size, "length": len(packed)}])

    spark = entries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = entries.repartitionByRange(n, "key").sortWithinPartitions("key", "file", "offset").mapInArrow(run, "first string, file string, offset long, length long")
    return sorted(tuple(r) for r in cut(files).collect())


class Index:
    """Looks up keys, in any order but best in key order, reading single blocks."""

    def __init__(self, at: str, files: list[tuple[str, str, int, int]], open_files: int = 32):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(at)
        self.files, self.firsts = files, [f[0].encode() for f in files]
        self.handles: dict[str, pa.NativeFile] = {}
        self.most, self.directories, self.block = open_files, {}, (None, [], [])

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.handles:
            while len(self.handles) >= self.most:
                self.handles.pop(next(iter(self.handles))).close()
            self.handles[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.handles[name].read_at(length, offset)

    def _entries(self, file: int, block: int) -> tuple[list[bytes], list[list]]:
        if self.block[0] != (file, block):
            _, name, _, _ = self.files[file]
            rows = [json.loads(x) for x in zlib.decompress(self.read(name, *self._directory(file)[1][block][1:])).decode().split("\n")]
            self.block = ((file, block), [r[0].encode() for r in rows], rows)
        return self.block[1:]

    def _directory(self, file: int) -> tuple[list[bytes], list[list]]:
        if file not in self.directories:
            _, name, offset, length = self.files[file]
            rows = json.loads(zlib.decompress(self.read(name, offset, length)))
            self.directories = {file: ([r[0].encode() for r in rows], rows)}
        return self.directories[file]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of all entries of a key. Equal keys may run over several blocks, but not over files."""
        raw = key.encode()
        file = bisect.bisect_right(self.firsts, raw) - 1
        if file < 0:
            return
        heads = self._directory(file)[0]
        block = max(0, bisect.bisect_left(heads, raw) - 1)
        while block < len(heads) and heads[block] <= raw:
            keys, rows = self._entries(file, block)
            i = bisect.bisect_left(keys, raw)
            while i < len(keys) and keys[i] == raw:
                yield tuple(rows[i][1:])
                i += 1
            block += 1


def read_captures(requests: DataFrame, at: str, files: list[tuple[str, str, int, int]]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of the requested (url, page_id)."""
    spark = requests.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(files)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([entry_key(u, p) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    def page(urn: str | None) -> int | None:
        value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
        return None if value == "none" else int(value)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, before = Index(at, shared.value), None
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                if key == before:
                    continue
                before = key
                for name, offset, length in index.find(key):
                    fields, payload = parse_record(zlib.decompress(index.read(name, offset, length), 31))
                    whole = fields["warc-type"] == "response"
                    digest = payload_digest(payload) if whole else fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if whole else int(fields["warc-payload-length"])
                    rows.append((page(fields["warc-record-id"]), size, digest, fields["warc-type"], page(fields.get("warc-refers-to")), payload if whole else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = requests.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(keys, "key string")
    return wanted.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, at: str, **options) -> list[tuple[str, str, int, int]]:
    """Writes pages and their index into one folder; the list of index files is what read_captures needs."""
    return write_index(write_archives(pages, at, **options), at)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = new_dir(spark, "warc")
    files = archive(pages, at)
    out = cut(read_captures(pages, at, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, at)
    return out
