"""WARC archives: writing with revisit records, normalising monolithic gzip, reading by offset.

Spark's text writer compresses each part file as one gzip stream. The normaliser inflates such
a stream once, piece by piece, writes every record as a gzip member of its own and puts a
sidecar index (record, offset, length) beside the archive, so that single records can be read
by seeking. A task holds one record at a time, never an archive. Part files are written under
a name of the attempt and then renamed, so a task that runs again, or twice, leaves the same
files.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
page id is the response and the others revisit it, without a body.

Defined results: a NULL page counts as the empty payload; NULL page ids are written as
``null`` and come after all others; repeated rows become records of their own (a copy of the
response's own row is a response again); control characters in addresses are percent-encoded;
an empty table gives empty archives. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.inputs import table
from contrastry.session import scratch_path

MIN_REVISIT = 100
RECORDS_PER_ARCHIVE = 5_000
CHUNK = 1 << 20
MEMBER_LEVEL = 5
INDEX = "archive string, offset long, length long, record string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def rooted(spark: SparkSession, path: str, beside: str) -> str:
    """``path`` as a URI. A path without a scheme is on the file system that Spark resolves such paths
    against, which tasks cannot tell; it is read off the names of the files under ``beside``."""
    if ":" in path.split("/")[0]:
        return path
    names = spark.read.format("binaryFile").load(beside).select("path").head(1)
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*(?=/))?", names[0][0])[0] + path if names else path


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` is accepted as Hadoop writes it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, its size and digest, and the page it revisits. Only ids and digests
    are grouped; groups are counted map-side, so a payload shared by many pages is no hot key."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    first = (
        rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1").select("payload_digest", "first_id")
    )
    joined = rows.join(first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))).drop("first_id")


def record_text(rows: DataFrame) -> DataFrame:
    """One column ``value`` with the record, up to its last line feed (which the writer adds)."""
    revisit = F.col("refers_to").isNotNull()
    address = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x1F\\x7F]", "%0A"), " ", "%20")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), address), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r")).alias("value"))


def write_monolithic(rows: DataFrame, path: str, records: int = RECORDS_PER_ARCHIVE) -> None:
    """Archives of at most ``records`` records, each one gzip stream."""
    record_text(rows).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a stream of one or more gzip members."""
    inflate = None
    while piece := stream.read(CHUNK):
        while piece:
            inflate = inflate or zlib.decompressobj(31)
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = None
    if inflate:
        raise ValueError("the archive ends inside a gzip member")


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record."""
    held = bytearray()
    head, need = None, 0
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
                need = end + 4 + int(head["Content-Length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held:
        raise ValueError("the archive ends inside a record")


def normalise_one(source: str, target_dir: str) -> tuple[str, str, int]:
    """Rewrite one archive with a member per record; returns archive, index and number of records."""
    files, path = opened(source)
    out_files, out_dir = opened(target_dir)
    name = path.rsplit("/", 1)[-1].split(".")[0]
    archive, index = f"{out_dir}/{name}.warc.gz", f"{out_dir}/{name}.cdxj"
    mark = f".{uuid.uuid4().hex}.tmp"
    offset = count = 0
    with files.open_input_stream(path, compression=None) as stream, out_files.open_output_stream(f"{out_dir}/_{name}{mark}", compression=None) as out, \
            out_files.open_output_stream(f"{out_dir}/_{name}-index{mark}", compression=None) as side:
        for head, record in records_of(inflated(stream)):
            packer = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            side.write((json.dumps({"archive": f"{name}.warc.gz", "offset": offset, "length": len(member), "record": head["WARC-Record-ID"]}) + "\n").encode())
            offset += len(member)
            count += 1
    out_files.move(f"{out_dir}/_{name}{mark}", archive)
    out_files.move(f"{out_dir}/_{name}-index{mark}", index)
    return archive, index, count


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives under ``source`` into ``target``; a row for each (archive, index, records)."""
    target = rooted(spark, target, source)
    files, path = opened(target)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalise_one(p, target) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["archive", "index", "records"]) if done else pa.RecordBatch.from_pylist([])

    # only names and lengths are scanned here; the tasks stream the contents themselves
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return archives.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, "archive string, index string, records long")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.cdxj").json(target)


def read_records(index: DataFrame, target: str, with_payload: bool = True) -> DataFrame:
    """The records at the offsets of an index, each inflated on its own; digests and sizes of
    responses are those of the payload that was read."""
    target = rooted(index.sparkSession, target, target)

    def number(field: str | None) -> int | None:
        tail = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(tail) if tail not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(target)
        handles: dict[str, object] = {}
        for batch in batches:
            rows = []
            held = 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive not in handles:
                    handles.clear()
                    handles[archive] = files.open_input_file(f"{folder}/{archive}")
                handles[archive].seek(offset)
                head, record = next(records_of(iter([zlib.decompress(handles[archive].read(length), 31)])))
                body = record[len(record) - 4 - int(head["Content-Length"]):-4]
                response = head["WARC-Type"] == "response"
                digest = hashlib.sha256(body).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha256:")
                if digest != head["WARC-Payload-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("WARC-Refers-To")),
                             len(body) if response else int(head["X-Payload-Length"]), digest, body.decode() if with_payload and response else None))
                held += len(body) if with_payload else 0
                if held > 8 * CHUNK:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [part.split(" ")[0] for part in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_monolithic(with_roles(pages), raw)
    normalise(spark, raw, target).agg(F.sum("records")).collect()  # runs the rewriting; one row comes back
    return read_records(read_index(spark, target), target, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_normaliser": op4_warc_normaliser}

SQL = {
    "op4_warc_normaliser": """
WITH body AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM body
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM firsts
"""
}
