"""WARC archives: writing with an index, and reading selected records by coalesced ranges.

Every record is a gzip member of its own.  Records with equal payloads are written once, as the response
with the smallest page_id; others are revisit records that refer to it.  Writing gives an index of
offset, length, URL and digest per record.  Reading sorts the selected index rows by file and offset, joins
neighbours into ranges of bounded size, and reads each range once.

Every attempt of a task writes a file of its own name, and only files named in the index that Spark commits are read, so a
lost or repeated task does no harm. Reading is dealt out by ranges of file and offset, RANGES bytes a task.
Null html is an empty payload; a null url is left out of the header. Rows that repeat page_id and html are written each,
with one type. Null ids come last among equal payloads. Payloads of any length are one record. Extra columns are ignored,
whatever their names; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import file_system, forget, heavy_join, new_path, small, written

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
GAP, RANGE, RANGES = 1 << 16, 8 << 20, 32 << 20


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> tuple[bytes, str]:
    digest = _base32(payload)
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0), digest


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        stream = None
        offset = 0
        for batch in small(batches, "html"):
            if stream is None:
                store, path = file_system(folder)
                store.create_dir(path, recursive=True)
                stream = store.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for r in batch.to_pylist():
                data, digest = _record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["record_type"], r["refers_to"])
                stream.write(data)
                rows.append({"file": name, "offset": offset, "length": len(data), "digest": digest} | {k: r[k] for k in ("url", "record_type", "page_id", "refers_to")})
                offset += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=_index)
        if stream is not None:
            stream.close()

    return run


_index = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64())])


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html, ...) to WARC files in folder; returns their index."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha2("html", 256), "long": F.octet_length("html") >= least})
    ids = written(pages.select("page_id", "digest", "long").distinct(), "warc-ids")
    heads = written(ids.groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("rows")), "warc-heads")
    kinds = heavy_join(ids, heads, "digest", "rows").select("page_id", "digest", (~F.col("long") | F.col("page_id").eqNullSafe(F.col("head"))).alias("own"), "head")
    kinds = written(kinds, "warc-kinds").withColumnsRenamed({"page_id": "k", "digest": "d"})
    forget(ids, heads)
    rows = pages.join(kinds, F.col("page_id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")))
    rows = rows.select("page_id", "url", "html", F.when(F.col("own"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("own"), F.col("head")).alias("refers_to"))
    index = written(rows.mapInArrow(_write(folder), INDEX), "warc-index")
    forget(kinds)
    return index


def _parse(record: bytes) -> dict:
    head, _, rest = zlib.decompress(record, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    ref = lambda name: int(x) if (x := fields.get(name, b"<urn:page:>")[10:-1]) else None
    return {"page_id": ref(b"WARC-Record-ID"), "url": fields.get(b"WARC-Target-URI", None), "record_type": fields[b"WARC-Type"].decode(), "refers_to": ref(b"WARC-Refers-To"), "digest": fields[b"WARC-Payload-Digest"][5:].decode(), "payload_bytes": said, "payload": payload}


def _read(folder: str):
    """Records of index rows sorted by file and offset."""

    def flush(store, path: str, rows: list[tuple[int, int]]) -> Iterator[dict]:
        with store.open_input_file(path) as source:
            first = rows[0][0]
            data = source.read_at(rows[-1][0] + rows[-1][1] - first, first)
        for offset, length in rows:
            yield _parse(data[offset - first : offset - first + length])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        held: list[tuple[int, int]] = []
        name = None

        def out(records: Iterator[dict]) -> pa.RecordBatch:
            rows = []
            for r in records:
                if r["record_type"] == "response" and (_base32(r["payload"]) != r["digest"] or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"damaged record of page {r['page_id']} in {name}")
                url = r["url"]
                rows.append(r | {"url": url if url is None else url.decode("utf-8", "replace")})
            return pa.RecordBatch.from_pylist(rows, schema=_records)

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if held and (file != name or offset - held[-1][0] - held[-1][1] > GAP or offset + length - held[0][0] > RANGE):
                    yield out(flush(store, f"{root}/{name}", held))
                    held = []
                name = file
                held.append((offset, length))
        if held:
            yield out(flush(store, f"{root}/{name}", held))

    return run


_records = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload) of the records in the rows of index."""
    size = index.agg(F.sum("length")).first()[0] or 0
    least = index.sparkSession.sparkContext.defaultParallelism
    rows = index.select("file", "offset", "length").repartitionByRange(max(least, size // RANGES), "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read(folder), "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives of all pages."""
    folder = new_path(pages.sparkSession, "warc")
    index = write_warc(pages, folder, least)
    return read_warc(index, folder).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
