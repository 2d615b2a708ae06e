"""WARC archives: deduplicated writing, and a splittable reader.

Every record is a gzip member of its own. A reading task owns a byte range of a file: it looks for
gzip magic there, accepts a place as a record when the header that decompresses from it is a
WARC header, and reads every record that starts inside its range, also where it ends outside.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import shuffle_partitions
from sirenlens.session import materialize, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one reading task owns.
SPLIT = 8 << 20
#: Bytes after which a writing task begins another file.
FILE = 256 << 20
#: Bytes read at a time, and decompressed to look at a candidate's header.
READ = 1 << 20
PEEK = 512
#: Fixed, so that archives of equal pages are equal.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 5

_MANIFEST = "path string, bytes long, records long"
_RECORD = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """A response, or without ``payload`` a revisit of page ``first``; both name size and digest of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%~!*()[]')}")
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{first}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    """Write a partition's records; a file appears under its name only when it is complete.

    A task that runs again writes the same records to the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        out, draft, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, number
            out.close()
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            system.move(f"{root}/{draft}", f"{root}/{name}")
            done.append((f"{folder}/{name}", size, count))
            out, number = None, number + 1

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "revisit", "first"))
            for page_id, url, payload, n, sha1, revisit, first in zip(*columns, strict=True):
                if out is None:
                    draft, size, count = f".{uuid.uuid4().hex}", 0, 0
                    out = system.open_output_stream(f"{root}/{draft}")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                body = None if revisit else (payload or "").encode()
                member = record(page_id, url, body, n, digest, first)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE:
                    close()
        if out is not None:
            close()
        names, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "bytes", "records"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` under ``folder``; returns the files written.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is a
    response and the others are revisits of it; a null id comes after all others, rows that share
    the smallest id are all responses. Null html is an empty payload. Equal payloads are found by
    digest alone, so html is moved only where a join with the revisits must.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("payload"),
        F.octet_length(html).cast("long").alias("size"),
        F.sha1(html).alias("sha1"),
    )
    narrow = rows.select("page_id", "size", "sha1")
    repeated = narrow.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(repeated.where("n > 1 and first is not null").drop("n"), "warc-repeated")
    again = narrow.select("page_id", "sha1").join(repeated, "sha1")
    again = again.where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = materialize(again.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "first"), "warc-revisits")
    same = (F.col("sha1") == F.col("_sha1")) & F.col("page_id").eqNullSafe(F.col("_id"))
    marked = rows.join(again, same, "left").withColumn("revisit", F.col("_sha1").isNotNull())
    kept = marked.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    kept = kept.select("page_id", "url", "payload", "size", "sha1", "revisit", "first")
    return materialize(kept.mapInArrow(_write(folder), _MANIFEST), "warc-manifest")


class Member:
    """A gzip member of an open file, decompressed from ``at``."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at

    def header_only(self) -> bytes:
        return zlib.decompressobj(31).decompress(self.file.read_at(PEEK, self.at), PEEK)

    def whole(self) -> tuple[bytes, int]:
        """Its content, and where the next member begins."""
        engine, out, at = zlib.decompressobj(31), [], self.at
        while not engine.eof:
            data = self.file.read_at(READ, at)
            if not data:
                raise EOFError(f"record at {self.at} is cut off")
            out.append(engine.decompress(data))
            at += len(data)
        return b"".join(out), at - len(engine.unused_data)


def is_record(file, at: int) -> bool:
    """Whether a WARC record begins here: magic alone also occurs inside compressed data."""
    try:
        return Member(file, at).header_only().startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file, begin: int, end: int) -> Iterator[bytes]:
    """All records that start in ``[begin, end)``."""
    data = file.read_at(end - begin + len(MAGIC) - 1, begin)
    at = begin
    while at < end:
        found = data.find(MAGIC, at - begin)
        if found < 0 or begin + found >= end:
            return
        at = begin + found
        if not is_record(file, at):
            at += 1
            continue
        content, at = Member(file, at).whole()
        yield content


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record (by lower-case name), of its HTTP message, and the payload."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        pairs = (line.decode().split(":", 1) for line in lines if b":" in line)
        return {name.strip().lower(): value.strip() for name, value in pairs}

    head, rest = content.split(b"\r\n\r\n", 1)
    warc = fields(head.split(b"\r\n")[1:])
    http, payload = rest[: int(warc["content-length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http.split(b"\r\n")[1:]), payload


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, begin, end in zip(*(batch[c].to_pylist() for c in ("path", "begin", "end")), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            rows = []
            with system.open_input_file(name) as file:
                for content in records_in(file, begin, end):
                    warc, http, payload = parse(content)
                    claimed = warc["warc-payload-digest"].removeprefix("sha1:")
                    revisit = warc["warc-type"] == "revisit"
                    size = int(http["content-length"]) if revisit else len(payload)
                    digest = claimed if revisit else base32_sha1(payload)
                    if digest != claimed:
                        raise ValueError(f"{warc['warc-record-id']} in {path} is damaged")
                    rows.append(
                        (_page_of(warc["warc-record-id"]), size, digest, warc["warc-type"],
                         _page_of(warc.get("warc-refers-to")), warc.get("warc-target-uri"))
                    )
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in _RECORD.split(", ")],
            )


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of ``files(path, bytes)``; a file of any size is read by many tasks."""
    begins = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(begins).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + split, F.col("bytes")))
    dealt = ranges.repartition(shuffle_partitions(files.sparkSession), "path", "begin")
    return dealt.mapInArrow(_scan, _RECORD)


def archive_folder(pages: DataFrame) -> str:
    return f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
