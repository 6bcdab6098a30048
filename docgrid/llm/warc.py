"""WARC archives: write with revisits, index first, then coalesced byte-range reads.

* Writing.  Each task appends gzip members - one WARC record each - to files of its own in the shared
  folder, and emits an index row (file, offset, length, url, digest) per record.  File names hold a
  random part, so a task that is run again writes other files; only rows of the attempt that
  succeeded are in the index, and the index is written before anything is read.
* Revisits.  Of the records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
  smallest page_id is the response; the others are revisits without payload that name it.  Digests
  are grouped with map-side combine, then joined back, so a payload that a third of all pages
  share never meets in one task.
* Reading.  The selected index rows are dealt by file and 64 MB segment, sorted by offset; neighbours
  with a gap of at most ``GAP`` bytes are fetched in one read of at most ``SPAN`` bytes.

The folder has to be on a file system that both Spark and pyarrow reach (local or mounted, HDFS, S3, GCS).

Defined cases: null html is the empty payload; null url omits the header; a null page_id never is the
response of others; rows that repeat the response's page_id and payload are responses too.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch_path

MIN_REVISIT = 100
FILE_BYTES = 1 << 30
GAP = 64 << 10
SPAN = 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, file string, offset long, length long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Page-ID": "" if page_id is None else str(page_id),
    }
    if url is not None:
        # line breaks and other controls can't stand in a header
        head["WARC-Target-URI"] = quote(url, safe="".join(chr(c) for c in range(33, 127) if c != 37))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest)
        head["Refers-To-Page-ID"] = str(refers_to)
        block = http + b"\r\n"
    else:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(text.encode() + block + b"\r\n\r\n") + press.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of a record; raises if its frame is broken."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, payload, payload_digest, refers_to (null: response)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.where(F.length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("payload_digest", "_first")
    )
    joined = rows.join(first, "payload_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("_first")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write :func:`mark_revisits` rows as ``*.warc.gz`` below ``folder``; the index, itself written first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)  # members are compressed already
                revisit = refers is not None
                member = encode_record(page, url, payload, digest, refers, revisit)
                out.write(member)
                index.append((page, "revisit" if revisit else "response", refers, url, digest, len(payload), name.rsplit("/", 1)[-1], at, len(member)))
                at += len(member)
            cols = list(zip(*index, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, folder: str, payload: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that ``index`` selects: page_id, record_type, refers_to, url, payload_bytes,
    payload_digest (both of what was read), stated_digest, payload (null for revisits, or if not wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        kinds = {
            "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(),
            "payload_bytes": pa.int64(), "payload_digest": pa.string(), "stated_digest": pa.string(), "payload": pa.binary(),
        }

        def fetched(want: list[tuple[str, int, int]]) -> Iterator[bytes]:
            """Members in the order asked for, which is by file and offset."""
            handle, opened, k = None, "", 0
            while k < len(want):
                name, start, length = want[k]
                end, stop = start + length, k + 1
                while stop < len(want) and want[stop][0] == name and want[stop][1] <= end + gap and want[stop][1] + want[stop][2] - start <= span:
                    end = max(end, want[stop][1] + want[stop][2])
                    stop += 1
                if name != opened:
                    if handle:
                        handle.close()
                    handle, opened = system.open_input_file(f"{base}/{name}"), name
                data = handle.read_at(end - start, start)
                for _, at, size in want[k:stop]:
                    yield data[at - start : at - start + size]
                k = stop
            if handle:
                handle.close()

        for batch in batches:
            rows = []
            for member in fetched(list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))):
                head, body = decode_record(member)
                revisit = head["WARC-Type"] == "revisit"
                rows.append(
                    (
                        int(head["Page-ID"]) if head["Page-ID"] else None,
                        head["WARC-Type"],
                        int(head["Refers-To-Page-ID"]) if revisit else None,
                        unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
                        None if revisit else len(body),
                        None if revisit else hashlib.sha256(body).hexdigest(),
                        head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        body if payload and not revisit else None,
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    dealt = (
        index.select("file", "offset", "length")
        .withColumn("_segment", F.shiftright("offset", 26))
        .repartition("file", "_segment")
        .sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
    )
    return dealt.mapInArrow(
        run,
        "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, stated_digest string, payload binary",
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits take size and digest from the response they name."""
    records = materialize(records.drop("payload"), "warc-read")
    whole = records.where("record_type = 'response'").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    named = whole.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = records.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", "stated_digest")
    found = again.join(named, ["refers_to", "stated_digest"], "left")
    return whole.unionByName(found.withColumnRenamed("stated_digest", "payload_digest"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_warc(mark_revisits(read(spark, sf_dir, "pages")), folder)
    found = resolve_revisits(read_warc(index, folder, payload=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLE = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""
}
