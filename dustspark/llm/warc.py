"""WARC archives of pages: one gzip member per record, and a splittable reader.

Writing: each task writes one archive under a temporary name of its attempt and renames it, so a repeated or lost task leaves
whole files only. Pages with equal payloads (SHA-1 and length) are one response, that of the smallest page_id; the others are
revisit records that refer to it.

Reading: the archives are cut into byte ranges. A task looks for gzip magic in its range, takes a place for a member only if it
decompresses to a WARC header, and owns the records that start inside its range, to their ends. After a record the next one is
expected right behind it. No index is needed, and a magic inside compressed data is refused by its header.

Null html is an empty payload; null urls are left out. Rows without page_id are never referred to: if no row of the payload has
an id, they are all responses. Rows that repeat page_id and payload are alike responses or revisits. Empty table: no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.llm.common import partitions, ship
from dustspark.session import cut_lineage, scratch

MAGIC = b"\x1f\x8b\x08"
LEAST_PAYLOAD = 0
SPLIT_BYTES = 8 << 20
BUFFER_BYTES = 1 << 20
READ_BYTES = 1 << 14
HEAD_BYTES = 1 << 10
LEVEL = 6


def _files(path: str):
    """File system and path of a URI, for any store that Arrow knows; a plain path is local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# ---- records
def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.0 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


# ---- writing
def assign(pages: DataFrame) -> DataFrame:
    """The rows with payload digest, record type and refers_to. Only ids and digests are shuffled by payload; html goes by page_id."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    marked = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    first = marked.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) & (F.col("bytes") >= LEAST_PAYLOAD))
    later = marked.join(first, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    later = later.select(F.col("page_id").alias("id"), "digest", F.col("first").alias("refers_to")).distinct()
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("digest")), "left").select(
        "page_id", "url", "html", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their list (path, bytes, records), one row per task that had rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, root = _files(folder)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        out = None
        size = count = 0
        part = f"{root}/_part-{uuid.uuid4().hex}"
        for batch in batches:
            for page_id, url, html, kind, to in zip(batch["page_id"], batch["url"], batch["html"], batch["record_type"], batch["refers_to"], strict=True):
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                raw = record(kind, None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, payload, digest,
                             None if pd.isna(to) else int(to))
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(part)
                out.write(raw)
                size += len(raw)
                count += 1
        if out is not None:
            out.close()
            files.move(part, name)
            yield pd.DataFrame({"path": [f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"], "bytes": [size], "records": [count]})
    ship(pages.sparkSession)
    rows = assign(pages)
    typed = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "record_type", F.col("refers_to").cast("long"))
    # the join has dealt the pages by id already
    return cut_lineage(typed.mapInPandas(run, "path string, bytes bigint, records bigint"))


# ---- reading
def members(source, start: int, stop: int, size: int) -> Iterator[bytes]:
    """Decompressed records whose member starts in [start, stop)."""
    held, low = b"", 0

    def at(place: int, n: int) -> bytes:
        nonlocal held, low
        n = min(n, size - place)
        if n <= 0:
            return b""
        if place < low or place + n > low + len(held):
            source.seek(place)
            held, low = source.read(min(BUFFER_BYTES, size - place)), place
        return held[place - low:place - low + n]

    def header(place: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(at(place, HEAD_BYTES), 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    place = start
    while place < stop:
        chunk = at(place, READ_BYTES)
        found = chunk.find(MAGIC)
        if found < 0:
            if place + len(chunk) >= size:
                return
            place += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        place += found
        if place >= stop:
            return
        if not header(place):
            place += 1
            continue
        unpack, raw, here = zlib.decompressobj(31), io.BytesIO(), place
        while not unpack.eof:
            chunk = at(here, READ_BYTES)
            if not chunk:
                raise ValueError(f"the member at {place} is cut off")
            raw.write(unpack.decompress(chunk))
            here += len(chunk)
        place = here - len(unpack.unused_data)
        yield raw.getvalue()


def read(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the listed archives (path, bytes): ids, type, digests, and the payload of responses."""
    splits = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                files, name = _files(path)
                rows: list[tuple] = []
                held = 0
                with files.open_input_file(name) as source:
                    for raw in members(source, int(start), min(int(start) + split_bytes, int(size)), int(size)):
                        fields, payload = parse(raw)
                        digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} differs from its digest")
                        page, to = (re.search(r"urn:page:(-?\d+)", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                        rows.append((int(page[1]) if page else None, fields.get("WARC-Target-URI"), length, digest, kind, int(to[1]) if to else None,
                                     payload if kind == "response" else None))
                        held += len(raw)
                        if held > 4 * BUFFER_BYTES:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    return splits.repartition(partitions(spark), "path", "start").mapInPandas(
        run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a fresh shared folder and reads the records back."""
    spark = pages.sparkSession
    return read(spark, write(pages, f"{scratch(spark)}/warc"))
