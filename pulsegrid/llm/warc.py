"""Deterministic sharded WARC writer, and its reader.

Records are sorted by url and page_id into ranges.  Each range rolls files by compressed size: every record is a gzip member
of its own, and a new file begins before a member that would pass the limit.  Headers and digests are made anew from the payload.
A file is written under a temporary name, then renamed; the names, sizes and digests of all files go into a manifest, renamed last,
which alone says what belongs to the archive.  Names and bytes depend only on the records and the number of ranges: no clock, no random.
A task that runs twice writes the same bytes under another temporary name, and the rename makes one of them the file.

Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is the response; the others are revisits,
which carry the payload's digest and length but not the payload.  A null html is an empty payload; a null url leaves out the target; rows
with a null page_id are responses without an id.  A repeated row (equal page_id and payload) writes its record once for each row: all
rows with the largest page_id are responses.  An empty table gives an archive of no files.
Pages of any length are one record each.  Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import gzip
import hashlib
import json
import os
import posixpath
import uuid
import zlib
from base64 import b32encode

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.session import cut_lineage

#: Compressed bytes of a file, and payload bytes of a range, about.
FILE_BYTES, RANGE_BYTES = 16 << 20, 64 << 20
LEAST = 0
#: Repeated payloads (some 100 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_REPEATS = 500_000
_DATE = "1970-01-01T00:00:00Z"
_FIELDS = "file string, bytes long, records long, sha256 string"


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, length: int, sha1: bytes) -> bytes:
    """One record with regenerated headers; a revisit has the length and digest of a payload that it does not carry."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", "sha1:" + b32encode(sha1).decode()), ("WARC-Block-Digest", "sha1:" + digest(block))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (empty for revisits), refers_to (null for responses), length, sha1."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    # Only payloads that occur again are looked up; their table is summed before it is shuffled.
    again = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last")
    again = cut_lineage(again)
    both = rows.join(F.broadcast(again) if again.count() <= BROADCAST_REPEATS else again, "sha1", "left")
    later = F.col("last").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("last"))
    # A revisit needs its payload's digest and length only.
    return both.select("page_id", "url", F.when(later, "").otherwise(F.col("html")).alias("html"), F.when(later, F.col("last")).alias("refers_to"),
                       F.octet_length("html").cast("long").alias("length"), F.unhex("sha1").alias("sha1"))


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder)


class _Rolling:
    """The files of one range."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.root = _open(folder)
        self.part, self.limit, self.number, self.done = part, limit, 0, []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self.name = f"part-{self.part:06d}-{self.number:04d}.warc.gz"
            self.temporary = posixpath.join(self.root, f".{self.name}.{uuid.uuid4().hex}")
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, posixpath.join(self.root, self.name))
            self.done.append((self.name, self.size, self.records, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def _write(folder: str, limit: int):
    def run(batches):
        files = _Rolling(folder, TaskContext.get().partitionId(), limit)
        for b in batches:
            for page, url, html, refers, length, sha1 in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "length", "sha1"))):
                files.add(gzip.compress(record(page, url, html.encode(), refers, length, sha1), 6, mtime=0))
        files.close()
        name, size, n, sha = zip(*files.done) if files.done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                         ["file", "bytes", "records", "sha256"])

    return run


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the archive into an empty folder that all machines share; returns its manifest (file, bytes, records, sha256)."""
    rows = roles(pages, least)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    sorted_ = rows.repartitionByRange(ranges, F.col("url").asc_nulls_last(), "page_id").sortWithinPartitions(F.col("url").asc_nulls_last(), "page_id")
    files = cut_lineage(sorted_.mapInArrow(_write(folder, file_bytes), _FIELDS))
    lines = "".join(json.dumps(r.asDict(), sort_keys=True) + "\n" for r in files.orderBy("file").toLocalIterator())
    temporary = posixpath.join(root, ".manifest." + uuid.uuid4().hex)
    with fs.open_output_stream(temporary) as out:
        out.write(lines.encode())
    fs.move(temporary, posixpath.join(root, "manifest.jsonl"))
    return files


#: Compressed bytes that are handed to the decompressor at once.
_STEP = 1 << 15


def parse(data: bytes):
    """Records of one file: (headers, block), member by member.

    A member's end is found by the decompressor; only what it left of its last step is looked at again.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            step = view[at:at + _STEP]
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        if not member.eof:
            raise EOFError("the last member of a file is cut short")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _read(batches):
    for b in batches:
        for content in b.column("content"):
            ids, lengths, digests, kinds, refers, ok = [], [], [], [], [], []
            for fields, block in parse(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                ids.append(_number(fields["WARC-Record-ID"]))
                lengths.append(int(http["Content-Length"]))
                digests.append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                kinds.append(fields["WARC-Type"])
                refers.append(_number(fields.get("WARC-Refers-To")))
                ok.append(digest(block) == fields["WARC-Block-Digest"].removeprefix("sha1:") and (kinds[-1] == "revisit" or digest(payload) == digests[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(refers, pa.int64()), pa.array(ok)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of every record of the files in the manifest."""
    names = spark.read.schema(_FIELDS).json(f"{folder}/manifest.jsonl").select(F.col("file").alias("name"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name", "left_semi")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    return files.select("content").mapInArrow(_read, schema)


def archive_folder(spark: SparkSession, kind: str = "warc") -> str:
    """The name of a fresh folder below the shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        import tempfile
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="spark-")
    shared = shared if "://" in shared or shared.startswith("file:") else "file://" + os.path.abspath(shared)
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read the archive back."""
    folder = archive_folder(pages.sparkSession)
    write(pages, folder)
    return read(pages.sparkSession, folder)
