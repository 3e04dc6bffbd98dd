"""WARC archives: writing with revisit records, and a splittable reader.

Each task writes one file of gzip members, a record each, through the file system of the shared folder. Pages with an
equal payload are written once, as the response with the smallest page_id; the others are revisit records that refer
to it. The reader deals byte ranges to tasks: a task looks for the gzip magic in its range, takes a candidate for a
member only if the header inflates to a WARC record, owns the records that start inside its range and reads the last
of them beyond its end.

Defined results: null html is an empty payload; a page with a null id is a response of its own that no revisit refers
to; rows that share the smallest id of a payload are all responses; a very long payload is one record, read whole; an empty
table gives an empty archive and result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.llm.common import scratch, stored

#: Bytes of an archive that one task reads.
SPLIT_BYTES = 4 << 20
#: Payloads of fewer bytes are never revisited.
MIN_REVISIT_BYTES = 0
LEVEL = 6
MAGIC = b"\x1f\x8b\x08"
# Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One record, uncompressed; response: the page that a revisit refers to."""
    revisit = response is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{x}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is None:
        head.append("X-No-URL: 1")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(response)}", f"X-Refers-To-Page-ID: {response}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, path: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes page_id, url, html to archives below path; returns the stored list of files (file, bytes)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    firsts = (
        keyed.where(F.octet_length("html") >= least)
        .select("sha", "page_id")
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha").alias("copied"), "first")
    )
    # Ids alone meet their payload's first record; the payloads are dealt by page, so copies of one do not meet in a task.
    known = stored(firsts, "firsts")
    copies = keyed.select("page_id", "sha").join(known, F.col("sha") == F.col("copied")).where("page_id <> first").select(F.col("page_id").alias("copy_id"), F.col("sha").alias("copy_sha"), "first").distinct()
    joined = keyed.join(copies, (F.col("page_id") == F.col("copy_id")) & (F.col("sha") == F.col("copy_sha")), "left")
    marked = joined.select("page_id", "url", "html", F.col("first").alias("response"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/.parts", recursive=True)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}.warc.gz"
        part, size, out = f"{base}/.parts/{name}.{context.taskAttemptId()}", 0, None
        for pdf in batches:
            for page_id, url, html, response in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["response"], strict=True):
                if out is None:
                    out = store.open_output_stream(part)
                data = member(record(None if pd.isna(page_id) else int(page_id), url, html.encode(), None if pd.isna(response) else int(response)))
                out.write(data)
                size += len(data)
        if out is not None:
            # The file gets its name when it is whole; a task that runs again writes the same bytes.
            out.close()
            store.move(part, f"{base}/{name}")
            yield pd.DataFrame({"file": [f"{base}/{name}"], "bytes": [size]})

    return stored(marked.mapInPandas(run, "file string, bytes long"), "archives")


class _Range:
    """Bytes of a file from an offset on, read in pieces."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, bytearray()

    def more(self, piece: int = 1 << 16) -> bool:
        self.file.seek(self.at + len(self.data))
        got = self.file.read(min(piece, self.size - self.at - len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _header_ok(data: bytes) -> bool:
    """Whether a gzip member starts here whose content starts as a record does."""
    with suppress(zlib.error):
        return zlib.decompressobj(31).decompress(bytes(data[:512]), 16).startswith(b"WARC/1.")
    return False


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end) of an open file."""
    r = _Range(file, start, size)
    while r.at < end:
        at = r.data.find(MAGIC)
        if at < 0:
            keep = min(2, len(r.data))
            r.drop(len(r.data) - keep)
            if not r.more():
                return
            continue
        r.drop(at)
        if r.at >= end:
            return
        while len(r.data) < 512 and r.more():
            pass
        if not _header_ok(r.data):
            r.drop(1)
            continue
        unpacker, content, fed = zlib.decompressobj(31), [], 0
        try:
            while not unpacker.eof:
                if fed == len(r.data) and not r.more(1 << 18):
                    break
                content.append(unpacker.decompress(bytes(r.data[fed:])))
                fed = len(r.data)
        except zlib.error:
            r.drop(1)
            continue
        if not unpacker.eof:
            r.drop(1)
            continue
        yield r.at, b"".join(content)
        r.drop(fed - len(unpacker.unused_data))


def parse(content: bytes) -> tuple:
    """The READ columns of one record, then its payload (None for a revisit)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, claimed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x.split(":", 1)[1] for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")))
    if kind == "response" and (len(payload) != size or digest(payload) != claimed):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that its header names")
    number = lambda k: int(fields[k]) if k in fields else None
    url = None if "X-No-URL" in fields else fields["WARC-Target-URI"]
    return number("X-Page-ID"), url, size, claimed, kind, number("X-Refers-To-Page-ID"), payload if kind == "response" else None


def read(spark: SparkSession, files: DataFrame, path: str, split: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """Reads archives by byte ranges; files: (file, bytes). With payload, responses carry theirs."""
    cuts = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    schema = READ + ", payload binary" * payload

    def run(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for pdf in batches:
            for name, size, start in zip(pdf["file"], pdf["bytes"], pdf["start"], strict=True):
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for _, content in records(f, int(size), int(start), int(start) + split):
                        rows.append(parse(content)[: 6 + payload])
                        held += len(content) * payload
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield _frame(rows, payload)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, payload)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cuts.repartition(parts).mapInPandas(run, schema)


def _frame(rows: list[tuple], payload: bool) -> pd.DataFrame:
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payload
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def write_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the records back."""
    path = scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, path), path).drop("url")
