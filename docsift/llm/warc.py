"""WARC archives as a PySpark Python data source, and their writer.

Every record is a gzip member of its own, whose extra field holds its compressed length, so that a reader skips what it
does not want without inflating it; members without that field are inflated to find their end. The reader plans one
partition for each ``partition_bytes`` of a file (from the offsets noted in the folder's manifests when it was written;
whole files where there are none), takes predicates on ``warc_type`` and other header columns, parses a record's headers
first and inflates its payload only if the record passed and option ``payload`` is not ``none``.

Files are opened through pyarrow.fs, so a folder is any URI that it knows (file, hdfs, s3, gs). A task writes a file
under a name of its own; only files of committed tasks get into the manifest, and readers open no others.

Defined results of ``archive_pages``: a null html is an empty payload; equal payloads of at least ``min_revisit_bytes``
have one response, that of the largest page_id (rows that share that page_id are all responses), and revisits; a null
page_id is never the response while another has the payload; an empty table gives an archive without records; control
characters and blanks of a url are left out of the header; rows that share a page_id share a record id; other columns are
not read. Payloads below ``min_revisit_bytes`` are written where they are; of the others, those of one digest are dealt
over SALTS tasks.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .shared import shared_dir

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_length long, payload_digest string, refers_to string, headers map<string, string>, payload binary"
_HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PARTITION_BYTES = 8 << 20
MIN_REVISIT_BYTES = 1000
BATCH_BYTES = 4 << 20
SALTS = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK = b"DS"  # of the gzip extra subfield with the member's length


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, _MARK, 4, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(payload))}).items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + payload + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


def _plain_at(file, at: int, end: int, wanted, payload: bool):
    """Of a file that isn't compressed, as _member_at; payloads that aren't wanted are passed over unread."""
    file.seek(at)
    raw = file.read(min(4096, end - at))
    while b"\r\n\r\n" not in raw:
        more = file.read(min(4096, end - at - len(raw)))
        if not more:
            raise ValueError("a WARC record ends early")
        raw += more
    head = raw.partition(b"\r\n\r\n")[0]
    headers = parse_headers(head)
    begin, size = at + len(head) + 4, int(headers.get("Content-Length", 0))
    take, body = wanted(headers), None
    if take and payload:
        file.seek(begin)
        body = file.read(size)
    return (headers if take else None), body, begin + size + 4


def _member_at(file, at: int, end: int, wanted, payload: bool):
    """Headers and payload of the record at an offset (None if it is not wanted), and the next offset."""
    file.seek(at)
    raw = file.read(min(4096, end - at))
    if raw[:2] != b"\x1f\x8b":
        return _plain_at(file, at, end, wanted, payload)
    size = None
    if raw[3] & 4:
        extra = raw[12 : 12 + struct.unpack("<H", raw[10:12])[0]]
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == _MARK:
                size = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
    inflate = zlib.decompressobj(31)
    out = inflate.decompress(raw, 4096)  # headers first
    while b"\r\n\r\n" not in out and not inflate.eof:
        out += inflate.decompress(inflate.unconsumed_tail or file.read(4096), 4096)
    head, _, rest = out.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    take = wanted(headers)
    if size is not None and not (take and payload):
        return (headers if take else None), None, at + size
    parts = [rest]
    if size is not None and size > len(raw):
        left = file.read(at + size - file.tell())
        parts.append(inflate.decompress(inflate.unconsumed_tail + left))
    else:
        while not inflate.eof:
            more = inflate.unconsumed_tail or file.read(1 << 16)
            if not more:
                raise ValueError("a WARC member ends early")
            parts.append(inflate.decompress(more))
    size = size if size is not None else file.tell() - at - len(inflate.unused_data)
    body = b"".join(parts)[: int(headers.get("Content-Length", 0))]
    return (headers if take else None), body if payload else None, at + size


def _folder(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    size: int
    cuts: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.payload = options.get("payload", "full") != "none"
        self.step = int(options.get("partition_bytes", PARTITION_BYTES))
        self.columns = columns
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((_HEADERS[name], (f.value,)))
            elif name in _HEADERS and isinstance(f, In):
                self.tests.append((_HEADERS[name], tuple(f.value)))
            elif name in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((_HEADERS[name], ()))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v if v else k in headers for k, v in self.tests)

    def partitions(self):
        fs, folder = _folder(self.path)
        listed = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        manifests = [x for x in listed if x.base_name.startswith("_manifest-")]
        files = []
        for m in manifests:
            with fs.open_input_stream(m.path) as f:
                files += [(f"{folder}/{x['name']}", x["size"], x["cuts"]) for x in json.loads(f.read())]
        if not manifests:
            files = [(x.path, x.size, [0]) for x in listed if x.path.endswith((".warc.gz", ".warc"))]
        out = []
        for path, size, cuts in files:
            begin = 0
            for cut in [*cuts[1:], size]:
                if cut - begin >= self.step or cut == size:
                    if cut > begin:
                        out.append(Slice(path, begin, cut))
                    begin = cut
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _folder(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            raw.seek(partition.start)
            # one slice of a file; a foreign file without offsets is read as it goes
            file = io.BytesIO(raw.read(partition.end - partition.start)) if partition.end - partition.start <= 4 * self.step else raw
            at, end = (0, partition.end - partition.start) if file is not raw else (partition.start, partition.end)
            while at < end:
                headers, payload, at = _member_at(file, at, end, self.wanted, self.payload)
                if headers is not None:
                    rows.append((headers, payload))
                    held += len(payload or b"")
                if held > BATCH_BYTES or len(rows) >= 5000:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows) -> pa.RecordBatch:
        cols = {k: pa.array([h.get(v) for h, _ in rows], pa.string()) for k, v in _HEADERS.items()}
        cols["content_length"] = pa.array([int(h.get("Content-Length", 0)) for h, _ in rows], pa.int64())
        cols["headers"] = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
        cols["payload"] = pa.array([p for _, p in rows], pa.binary())
        return pa.record_batch([cols[c] for c in self.columns], self.columns)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        name, at, records, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                names = batch.schema.names
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    row = dict(zip(names, row, strict=True))
                    headers = {h: row[c] for c, h in _HEADERS.items() if row.get(c) is not None} | dict(row.get("headers") or {})
                    data = member(record(headers, row.get("payload") or b""))
                    if at - cuts[-1] >= self.step:
                        cuts.append(at)
                    out.write(data)
                    at += len(data)
                    records += 1
        return Written(name, records, at, cuts)

    def commit(self, messages):
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        done = [{"name": m.name, "size": m.size, "cuts": m.cuts, "records": m.records} for m in messages if m and m.records]
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(done).encode())

    def abort(self, messages):
        fs, folder = _folder(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/{m.name}")


class WarcDataSource(DataSource):
    """Format ``docsift_warc``; options path, payload (full or none), partition_bytes."""

    @classmethod
    def name(cls):
        return "docsift_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a response or revisit record for every page."""
    register(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("body"), F.sha1(html).alias("digest"), F.length(html).cast("long").alias("size"))
    short, long = full.filter(F.col("size") < min_revisit_bytes), full.filter(F.col("size") >= min_revisit_bytes)
    first = long.groupBy("digest").agg(F.max("page_id").alias("first_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    both = salted.join(first, ["digest", "salt"], "left").select(*full.columns, "first_id").union(short.select("*", F.lit(None).cast("long")))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    own = F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))
    clean = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "")
    records = both.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        own.alias("record_id"),
        clean.alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.col("size").alias("content_length"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        F.when(again, F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string"), F.lit("WARC-Profile"), F.lit(_PROFILE))).otherwise(F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string"))).alias("headers"),
        F.when(~again, F.col("body")).alias("payload"),
    )
    records.write.format("docsift_warc").mode("append").option("path", folder).save()


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("docsift_warc").option("payload", "full" if payload else "none").load(folder)


def _page(c: str):
    return F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    response = read_archive(spark, folder).filter("warc_type = 'response'")
    revisit = read_archive(spark, folder, payload=False).filter("warc_type = 'revisit'")
    page_id = F.when(F.col("record_id") != "<urn:page:>", _page("record_id")).alias("page_id")
    stored = response.select(page_id, F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = revisit.select(page_id, F.element_at("headers", "X-Payload-Length").cast("long").alias("payload_bytes"), F.substring("payload_digest", 6, 40).alias("payload_digest"), F.col("warc_type").alias("record_type"), _page("refers_to").alias("refers_to"))
    return stored.union(again)


ORACLE = """
WITH full_pages AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages),
marked AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) END AS first_id FROM full_pages)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM marked
"""
