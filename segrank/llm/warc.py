"""WARC archives with the index first: records are found by offset and read in few, large ranges.

Writing returns an index of file, offset, length, URL and digest of every record, each a gzip member
of its own.  Reading sorts the selected records by place, joins neighbouring byte ranges into one
read, and checks every payload against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from segrank.llm.common import materialize, new_path, require, small_enough, spread_join

#: Bytes after which a new archive begins; of a range that one task reads; of one read; and of a gap that is read rather than skipped.
ARCHIVE_BYTES, SPLIT_BYTES, READ_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 4 << 20, 64 << 10
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id string, file string, offset long, length long, url string, digest string, record_type string"


def open_file(uri: str, mode: str):
    """A binary file by URI: paths without a scheme and file: ones directly, others through Arrow's file systems (s3, gs, hdfs); s3a is read as s3."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if "://" not in uri or uri.startswith("file:"):
        path = re.sub(r"^file:/+", "/", uri)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_file(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One record; a revisit has the headers of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """_id, _sha, first: pages whose payload, of ``min_bytes`` or more, a page of a smaller id has too."""
    page = F.coalesce(F.col(html_col), F.lit(""))
    seen = materialize(pages.select(F.col(id_col).alias("_id"), F.sha1(page).alias("_sha"), F.octet_length(page).alias("_n")), "digests")
    many = seen.where(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(spread_join(seen, many, ["_sha", "_n"], "_id").where("_id > first or (_id is null and first is not null)").select("_id", "_sha", "first").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` below ``folder``; returns the index, which is written beside the archives.

    A null page is an empty payload. Of equal payloads of ``min_bytes`` or more the one of the smallest id is the
    response; smaller ones are all responses. Rows of the smallest id that repeat are responses each; a null id
    revisits the smallest other. A task that is run again writes files of other names, and only files that the
    index names count.
    """
    require(pages, id_col, url_col, html_col)
    again = revisits(pages, id_col, html_col, min_bytes)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    if again.limit(1).count():
        known = again.select(F.col("_id").alias("_i"), F.col("_sha").alias("_s"), "first")
        on = rows["_id"].eqNullSafe(F.col("_i")) & (F.sha1(F.coalesce("_html", F.lit(""))) == F.col("_s"))
        rows = rows.join(F.broadcast(known) if small_enough(known, F.lit(64)) else known, on, "left")
    else:
        rows = rows.withColumn("first", F.lit(None).cast("string"))
    rows = rows.select(F.col("_id").cast("string"), "_url", "_html", F.col("first").cast("string"))
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, out, at = TaskContext.get(), 0, None, 0
        try:
            for batch in batches:
                index = []
                for k in range(batch.num_rows):
                    page, url, html, first = (batch.column(c)[k].as_py() for c in range(4))
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{part:03d}.warc.gz"
                        out, at, part = open_file(name, "wb"), 0, part + 1
                    payload = (html or "").encode("utf-8")
                    digest = digest_of(payload)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = packer.compress(record(str(page), url, payload, first, digest)) + packer.flush()
                    out.write(data)
                    index.append((str(page), name, at, len(data), url, digest, "response" if first is None else "revisit"))
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    index = rows.mapInArrow(write, INDEX)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def ranges(places: Iterator[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, offset, length, records): sorted records joined into reads of ``most`` bytes, or of one larger record."""
    now: tuple | None = None
    for file, offset, length in places:
        if now and now[0] == file and offset - (now[1] + now[2]) <= gap and offset + length - now[1] <= most:
            now[3].append((offset, length))
            now = (file, now[1], max(now[2], offset + length - now[1]), now[3])
        else:
            if now:
                yield now
            now = (file, offset, length, [(offset, length)])
    if now:
        yield now


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits) of the records that ``index`` selects."""
    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]
    part = F.expr(f"offset div {SPLIT_BYTES}")
    size = index.agg(F.sum("length")).first()[0] or 0  # tasks follow the bytes of the records, not those of the index
    places = index.select("file", "offset", "length").repartition(int(size // SPLIT_BYTES) + 1, "file", part).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

        source, name, out, size = None, None, [], 0
        for file, start, length, records in ranges(rows()):
            if file != name:
                if source is not None:
                    source.close()
                source, name = open_file(file, "rb"), file
            source.seek(start)
            data = source.read(length)
            for offset, n in records:
                headers, payload = parse(zlib.decompress(data[offset - start : offset - start + n], 31))
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"the payload at {file}:{offset} isn't what its digest says")
                page = headers["warc-record-id"][len("<urn:page:") : -1]
                refers = headers["warc-refers-to"][len("<urn:page:") : -1] if kind == "revisit" else None
                out.append((None if page == "None" else page, int(headers["warc-payload-length"]), digest, kind, refers, payload if kind == "response" else None)[: len(names)])
                size += len(payload) * with_payload + 100
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
        if source is not None:
            source.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return places.mapInArrow(read, schema)


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder and read every record back: id, payload_bytes, payload_digest, record_type, refers_to, one row for each row of ``pages``.

    An empty table gives no rows; null and empty pages are empty payloads; pages of any length are one record each; extra
    columns aren't read, whatever their names. See write_archives() for ties, repeated rows and null ids.
    """
    index = write_archives(pages, new_path(pages.sparkSession, "warc"), id_col, url_col, html_col, min_bytes)
    kind = pages.schema[id_col].dataType
    out = read_records(index)
    return out.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
