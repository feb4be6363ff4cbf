"""WARC archives of pages: written by tasks into a folder that all see, and read back in sequence.

One gzip member holds one record. Equal payloads are stored once: the page with the largest id is the response, the
others are revisits that name it and keep its HTTP headers. The reader takes an archive in blocks, decompresses member by
member, frames header and block by Content-Length, and checks the digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .shared import keyed_join, new_path, written

#: Compressed bytes after which a task begins another archive; level of compression; bytes that are read at once.
ARCHIVE_BYTES, LEVEL, READ_BYTES = 64 << 20, 6, 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NUMBER = re.compile(rb"<urn:page:(-?\d+)>")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC header, then the HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha1 + str(url))}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, revisit, refers_to of each page.

    Of pages with equal payloads of at least min_bytes bytes the one with the largest id is the response; pages that
    repeat that id are responses too, and so are all where every id is null.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = rows.withColumn("sha1", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = marked.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    repeated = written(groups.filter("n > 1"), "repeated-payloads")
    found = keyed_join(marked, repeated, ["sha1", "bytes"], "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return found.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as WARC files to folder (a URL that all tasks can write to) and return (path, records, bytes).

    A file appears under its name only when it is whole, and a task that runs again replaces it by the same.
    """

    def make():
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()

        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            k, out, n, size = 0, None, 0, 0
            part = f"{root}/part-{task.partitionId():06d}-"
            draft = f"{root}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"

            def close() -> tuple:
                out.close()
                store.move(draft, f"{part}{k:04d}.warc.gz")
                return f"{folder}/{part.rpartition('/')[2]}{k:04d}.warc.gz", n, size

            for page_id, url, html, sha1, revisit, refers_to in given:
                if out is None:
                    out, n, size = store.open_output_stream(draft), 0, 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit)) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    k, out = k + 1, None
            if out is not None:
                yield close()

        return run

    return written(map_rows(with_types(pages, min_bytes), make, "path string, records long, bytes long"), "archives")


def records(stream) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one after another."""
    data, member, parts = b"", zlib.decompressobj(31), []
    begun = False
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                if begun:
                    raise ValueError("the archive ends within a record")
                return
        begun = True
        parts.append(member.decompress(data))
        data = member.unused_data
        if member.eof:
            yield b"".join(parts)
            member, parts, begun = zlib.decompressobj(31), [], False


def parse(raw: bytes) -> tuple[dict[str, bytes], bytes, bytes]:
    """(WARC header, HTTP header, payload) of one record, its framing and digests checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has not the {n} bytes it announces")
    if fields.get("warc-block-digest", b"sha1:" + digest(block).encode()) != b"sha1:" + digest(block).encode():
        raise ValueError("a block differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == b"response" and fields["warc-payload-digest"] != b"sha1:" + digest(payload).encode():
        raise ValueError("a payload differs from its digest")
    return fields, http, payload


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload (null for revisits) of each record.

    archives has the files in column path. payload_bytes and payload_digest are those of the full payload, for
    revisits too. A damaged archive is an error.
    """

    def make():
        from pyarrow import fs

        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for (path,) in given:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in records(stream):
                        fields, http, payload = parse(raw)
                        kind = fields["warc-type"].decode()
                        page, refers = (NUMBER.fullmatch(fields.get(k, b"")) for k in ("warc-record-id", "warc-refers-to"))
                        full = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1]) if kind == "revisit" else len(payload)
                        yield int(page[1]) if page else None, fields.get("warc-target-uri", b"").decode() or None, kind, full, fields["warc-payload-digest"].decode().removeprefix("sha1:"), int(refers[1]) if refers else None, payload if payloads and kind == "response" else None

        return run

    tasks = max(1, archives.count())
    paths = archives.select("path").repartition(min(tasks, 10_000), "path")
    return map_rows(paths, make, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back.

    A null html is an empty payload; a null or odd url is left out or escaped; null ids come back null. An empty
    table gives no archive and no rows.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), min_bytes)
    return read_archives(spark, archives, payloads)
