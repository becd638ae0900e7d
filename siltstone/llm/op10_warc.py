"""WARC archives of pages, index first.

Tasks write records as gzip members to archives in the shared folder and return an index row (file, offset, length, URL,
digest) for each. Only the index says what counts: archives of lost or repeated attempts are in no index row. Reading
selects index rows, sorts them by place, and joins neighbouring byte ranges into one read each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import new_folder, small, stage
from siltstone.llm.textkit import tidy

INDEX = "page_id bigint, url string, digest string, record_type string, file string, offset bigint, length bigint"
READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
#: Smallest payload that is stored once only.
REVISIT_BYTES = 100
#: A read joins ranges no more than GAP bytes apart, up to SPAN bytes.
GAP, SPAN = 1 << 16, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record. With ``refers_to`` a revisit without payload; its HTTP headers still tell the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _write(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        offset = 0
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                payload = r["html"].encode()
                digest = hashlib.sha256(payload).hexdigest()
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = press.compress(record(r["page_id"], r["url"], payload, digest, r["refers_to"], date)) + press.flush()
                out.write(data)
                rows.append((r["page_id"], r["url"], digest, "response" if r["refers_to"] is None else "revisit", name, offset, len(data)))
                offset += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.close()

    return tidy(run)


def write_warc(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html; null html: empty) and returns the staged index.

    Of rows with equal payloads of at least REVISIT_BYTES bytes those with the smallest page_id are responses, others
    revisit it (a null page_id is never the smallest; if all are null, all are responses). Only digests and ids are
    shuffled to find the copies. No rows: an empty index and no archive."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    x = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    large = F.octet_length("html") >= REVISIT_BYTES
    copies = x.where(large).select("page_id", digest.alias("d")).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = small(stage(copies.where("n > 1 and first is not null").select("d", "first"), "warc-copies"))
    x = x.join(copies, F.when(large, digest) == F.col("d"), "left")
    x = x.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return stage(x.mapInArrow(_write(folder, date, level), INDEX), "warc-index")


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = lambda x: None if x is None else int(x)

    def records(span: list[dict], opened: dict) -> list[tuple]:
        first, file = span[0]["offset"], span[0]["file"]
        if file not in opened:
            opened.clear()
            store, path = fs.FileSystem.from_uri(file)
            opened[file] = store.open_input_file(path)
        data = opened[file].read_at(span[-1]["offset"] + span[-1]["length"] - first, first)
        out = []
        for r in span:
            warc, http, payload = parse(zlib.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]], 31))
            digest = warc["warc-payload-digest"].removeprefix("sha256:")
            if warc["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{file} at {r['offset']}: the payload does not have its digest")
            out.append((whole(warc.get("page-id")), r["url"], payload, int(http["content-length"]), digest, warc["warc-type"], whole(warc.get("refers-to-page-id"))))
        return out

    opened: dict = {}
    for batch in batches:
        span: list[dict] = []
        done: list[tuple] = []
        for r in [*batch.to_pylist(), None]:
            if span and (r is None or r["file"] != span[0]["file"] or not 0 <= r["offset"] - span[-1]["offset"] - span[-1]["length"] <= GAP or r["offset"] + r["length"] - span[0]["offset"] > SPAN):
                done += records(span, opened)
                span = []
                if sum(len(x[2]) for x in done) > SPAN or r is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                    done = []
            if r is not None:
                span.append(r)


def read_warc(index: DataFrame) -> DataFrame:
    """The records of the given index rows: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has an empty payload and the length and digest of the full one. Index rows are dealt by file and SPAN
    bytes of it, so that large archives are read by many tasks."""
    rows = index.select("file", "offset", "length", "url")
    dealt = rows.repartition("file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to, url
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND payload_bytes >= 100"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": ORACLE}
