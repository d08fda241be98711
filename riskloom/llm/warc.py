"""WARC archives with a two-level capture index.

Records are gzip members in files of bounded size. Of pages with equal payloads the one with the smallest id is stored
as a response; the others become revisit records that name it. The capture index is sorted by reversed-host URL key and
page id and dealt into files by range; each file holds compressed blocks of lines and, at its end, a sparse directory
with the first key of every block. A look-up bisects the files' first keys, then a file's directory, reads one block by
its range, bisects its lines, and reads the record by its range in the archive.

Rows: null html is an empty payload; a null url has an empty key; a null page id is stored and is a response only where
no page with an id has its payload; rows that repeat an id and an equal payload are stored each with the same kind;
rows that repeat an id under urls of one key are found once each; a very long page is one record, held whole by its task;
empty tables give empty archives; extra columns are ignored. Files that a lost or repeated task attempt leaves are in no
index and are never read. Files go through pyarrow's file systems to the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, shared_dir, shuffle_partitions, slices

FILE_BYTES = 64 << 20
BLOCK_LINES = 512
#: No page id sorts after this one; it stands for a null id in index lines.
NO_ID = 2**63 - 1


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query, without scheme, user and fragment: com,example,www)/path?query."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def gz(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; refers_to makes it a revisit, which holds the response's headers only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_name(page_id), "WARC-Date": date, "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"), "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": "" if page_id is None else str(page_id)}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_name(refers_to), "Refers-To-Page-ID": str(refers_to)}
    body = http if refers_to is not None else http + payload
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of one compressed record; payload is None for a revisit."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(fields[name]) if fields.get(name) else None
    out = {"page_id": number("Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-ID"), "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}
    if out["record_type"] == "response":
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
            raise ValueError("a payload differs from its digest")
        out["payload"] = payload
    return out


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds `first`: the smallest id of the pages with an equal payload, where more than one has it."""
    keyed = pages.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    shared = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 and first is not null").select("digest", "first")
    return keyed.join(materialize(shared, "payloads"), "digest", "left").drop("digest")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each page (page_id, url, html); returns key, page_id, path, offset, length of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in slices(batches, 512, 8 << 20):
            rows = []
            for page_id, url, html, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first"))):
                refers_to = first if first is not None and (page_id is None or page_id > first) else None
                member = gz(record(page_id, url, html.encode(), refers_to, date))
                if out is None or at + len(member) > file_bytes and at:
                    if out is not None:
                        out.close()
                    name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.record_batch([pa.array(c) if i != 1 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], ["key", "page_id", "path", "offset", "length"])
        if out is not None:
            out.close()

    whole = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return materialize(with_first(whole, min_bytes).mapInArrow(run, "key string, page_id bigint, path string, offset bigint, length bigint"), "captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[list, str]]:
    """Writes the sorted index files; returns (first key and id, path) of each file, in order: a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at, directory, lines = f"{path}/{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> int:
            block = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            directory.append([lines[0][:2], at, len(block)])
            out.write(block)
            lines.clear()
            return len(block)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(name, compression=None)
                lines.append(row)
                if len(lines) == block_lines:
                    at += flush()
        if out is not None:
            if lines:
                at += flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + at.to_bytes(8, "little") + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.record_batch([pa.array([directory[0][0][0]]), pa.array([directory[0][0][1]], pa.int64()), pa.array([name])], ["key", "page_id", "path"])

    n = shuffle_partitions(captures.sparkSession)
    lines = captures.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "path", "offset", "length")
    ordered = lines.repartitionByRange(n, "key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")
    files = materialize(ordered.mapInArrow(run, "key string, page_id bigint, path string"), "index-files")
    return sorted(([r.key, r.page_id], r.path) for r in files.collect())


class CaptureIndex:
    """Look-ups in index files; the last directories, blocks and open archives are kept."""

    def __init__(self, files: list[tuple[list, str]], uri: str):
        self.firsts, self.paths = [f[0] for f in files], [f[1] for f in files]
        self.store = fs.FileSystem.from_uri(uri)[0]
        self.opened = lru_cache(16)(self.store.open_input_file)
        self.directory = lru_cache(8)(self.directory)
        self.block = lru_cache(8)(self.block)

    def span(self, path: str, at: int, length: int) -> bytes:
        return self.opened(path).read_at(length, at)

    def directory(self, file: int) -> list:
        path = self.paths[file]
        size = self.opened(path).size()
        tail = self.span(path, size - 16, 16)
        return json.loads(zlib.decompress(self.span(path, int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little"))))

    def block(self, file: int, nth: int) -> list:
        _, at, length = self.directory(file)[nth]
        return [json.loads(x) for x in zlib.decompress(self.span(self.paths[file], at, length)).split(b"\n")]

    def captures(self, low: list, high: list) -> Iterator[list]:
        """The lines from low to high, both [key, page id] and included."""
        file = max(0, bisect_left(self.firsts, low) - 1)
        while file < len(self.paths) and self.firsts[file] <= high:
            directory = self.directory(file)
            nth = max(0, bisect_left(directory, low, key=lambda b: b[0]) - 1)
            while nth < len(directory) and directory[nth][0] <= high:
                lines = self.block(file, nth)
                a, b = bisect_left(lines, low, key=lambda x: x[:2]), bisect_right(lines, high, key=lambda x: x[:2])
                yield from lines[a:b]
                if b < len(lines):
                    return
                nth += 1
            file += 1

    def read(self, line: list) -> dict:
        return parse(self.span(*line[2:5]))


def look_up(wanted: DataFrame, files: list[tuple[list, str]], folder: str) -> DataFrame:
    """Reads the captures of wanted (url and page_id; a null `page_id` column entry stands for captures without id)."""
    fields = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    held = wanted.sparkSession.sparkContext.broadcast(files)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([url_key(u) for u in batch["url"].to_pylist()], pa.string()), batch["page_id"]], ["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(held.value, folder)
        for batch in slices(batches, 128):
            rows = []
            for key, page_id in zip(batch["key"].to_pylist(), batch["page_id"].to_pylist()):
                at = [key, NO_ID if page_id is None else page_id]
                rows += [index.read(line) for line in index.captures(at, at)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    n = shuffle_partitions(wanted.sparkSession)
    asked = wanted.select("url", F.col("page_id").cast("bigint").alias("page_id")).mapInArrow(keys, "key string, page_id bigint").distinct()  # urls of one key are asked for once
    return asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, fields)


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index for pages (page_id, url, html) and reads every capture back through the index."""
    folder = shared_dir(spark, "warc")
    files = build_index(write_archives(pages, f"{folder}/archive", min_bytes), f"{folder}/index")
    return look_up(pages.select("url", "page_id"), files, folder)
