"""WARC archives with a two-level capture index.

Records are gzip members, gathered to rows of about ``chunk_bytes`` and written by Spark's own text
writer, ``per_file`` rows to a file, so files are bounded by bytes (a zero byte stands between rows,
which gzip readers take as padding).

The index: captures, keyed by the URL with its host reversed, are sorted over the whole archive and
laid out in compressed blocks of ``block_lines`` lines.  Each index file, one of a range of keys, ends
with a sparse directory of its blocks: first key, last key and byte range of each.  A search
(``find``) deals the keys it is asked for over tasks, each of which bisects the files by their first
keys and the file's directory by block; then every block that is wanted is read by its byte range
and its lines are bisected.  ``fetch`` reads the records by their byte ranges alone.  Both seek in
the files (through pyarrow's file systems: local or mounted folders, hdfs, s3, gs); no file is read
whole but once, by pieces, when it is indexed.  One key that very many captures have is no
large group: its blocks are searched, and its records read, in different tasks.

Defined results: a null html is an empty payload; a null url gives a record without a target and the
empty key; of records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is a response and the others are revisits of it, smaller payloads are all responses;
rows that repeat an id are kept each, rows without one are responses; an empty table gives an empty archive and index; a record
whose payload does not have its digest is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import shared_dir, slices, stash, table

_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAD = "\0"
_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def written_url(url: str | None) -> str | None:
    """The URL as a record has it: white space and control characters escaped."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and joined by commas, then ``)`` and the rest."""
    url = re.sub(r"[\t\r\n]", " ", url or "")
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not found:
        return (url or "").lower()
    host = found[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (found[2] or "") + ")" + (found[3].lower() or "/")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {written_url(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _number(text: str) -> int | None:
    return int(text) if text else None


def parse(raw: bytes) -> dict:
    """The fields of one uncompressed record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not have its digest")
    return {
        "page_id": _number(fields["WARC-Record-ID"][1:-1].removeprefix(_ID)),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "refers_to": int(fields["WARC-Refers-To"][1:-1].removeprefix(_ID)) if revisit else None,
        "payload": None if revisit else payload,
    }


class Files:
    """Files in shared storage, opened once and read by ranges."""

    def __init__(self):
        self.opened: dict[str, pa.NativeFile] = {}

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self.opened:
            if len(self.opened) >= 64:
                self.close()
            system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            self.opened[path] = system.open_input_file(place)
        return self.opened[path]

    def size(self, path: str) -> int:
        return self._file(path).size()

    def read(self, path: str, at: int, length: int) -> bytes:
        return self._file(path).read_at(length, at)

    def close(self) -> None:
        for file in self.opened.values():
            file.close()
        self.opened = {}


def members(files: Files, path: str, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, read by pieces."""
    size, at, data, base = files.size(path), 0, b"", 0
    while at < size:
        if at >= base + len(data):
            data, base = files.read(path, at, piece), at
        if data[at - base] == 0:
            at += 1
            continue
        unpack, parts, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= base + len(data):
                data, base = files.read(path, fed, piece), fed
                if not data:
                    raise ValueError(f"{path} is cut off")
            parts.append(unpack.decompress(memoryview(data)[fed - base :]))
            fed = base + len(data) - len(unpack.unused_data)
        yield at, fed - at, b"".join(parts)
        at = fed


def _write_rows(df: DataFrame, path: str, per_file: int = 0) -> None:
    df.select(F.col("row").cast("string").alias("value")).write.option("lineSep", _PAD).option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of the files below a path that are not empty; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", level: int = 4, chunk_bytes: int = 4 << 20, per_file: int = 16) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    # who refers to whom is settled by ids and digests alone; payloads travel, if at all, by their ids
    ids = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha")
    firsts = stash(ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", "refers_to"), "warc-copies")
    refers = stash(ids.join(firsts, "sha").where("page_id <> refers_to").distinct(), "warc-refers")
    linked = rows.join(refers, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices([batch], "payload"):
                for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    held.append(gzip.compress(record(*row, date), level, mtime=0))
                    size += len(held[-1])
                    if size >= chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["row"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["row"])

    _write_rows(linked.mapInArrow(pack, "row binary"), path, per_file)


def write_index(spark: SparkSession, archive: str, index: str, *, block_lines: int = 3000) -> None:
    """Index the archive: below ``index`` files of sorted compressed blocks, each with the directory of its blocks at its end."""

    def captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for path in batch.column("file").to_pylist():
                found = [(url_key((fields := parse(raw))["url"]), fields["page_id"], path, at, length) for at, length, raw in members(files, path)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["key", "page_id", "file", "at", "length"])
        files.close()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        listed: list[str] = []
        at = 0
        row = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["row"])

        def block() -> pa.RecordBatch:
            nonlocal at
            data = gzip.compress("\n".join("\t".join("" if x is None else str(x) for x in line) for line in lines).encode(), 6, mtime=0)
            listed.append(f"{lines[0][0]}\t{lines[-1][0]}\t{at}\t{len(data)}")
            at += len(data) + 1
            lines.clear()
            return row(data)

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) >= block_lines:
                    yield block()
        if lines:
            yield block()
        if listed:
            directory = gzip.compress("\n".join(listed).encode(), 6, mtime=0)
            yield row(directory)
            yield row(f"{at:020d}{len(directory):020d}".encode())

    spread = _paths(spark, archive).select("file")
    # a number given: by the few bytes of their names the files would all be dealt to one task
    found = spread.repartition(max(1, spread.count()), "file").mapInArrow(captures, "key string, page_id long, file string, at long, length long")
    ordered = found.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    _write_rows(ordered.mapInArrow(blocks, "row binary"), index)


def _directory(files: Files, path: str, size: int) -> list[list]:
    """First key, last key, offset and length of the blocks of an index file, from its end."""
    at, length = (int(files.read(path, size - 41, 40)[k : k + 20]) for k in (0, 20))
    return [[a, b, int(c), int(d)] for a, b, c, d in (line.split("\t") for line in zlib.decompress(files.read(path, at, length), 31).decode().split("\n"))]


def find(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """(key, page_id, file, at, length): the captures of the keys in ``wanted`` (key)."""

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = _directory(files, path, size)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (listed[0][0], listed[-1][1], path, size)], names=["first", "last", "file", "size"])
        files.close()

    # a row for each index file, of which there are as many as partitions
    parts = sorted(tuple(r) for r in _paths(spark, index).mapInArrow(ends, "first string, last string, file string, size long").collect())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that may hold each key."""
        files, known = Files(), {}
        first, last = [p[0] for p in parts], [p[1] for p in parts]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key in batch.column("key").to_pylist():
                for k in range(bisect_left(last, key), bisect_right(first, key)):
                    path, size = parts[k][2:]
                    if path not in known:
                        if len(known) >= 8:
                            known.clear()
                        listed = _directory(files, path, size)
                        known[path] = listed, [b[0] for b in listed], [b[1] for b in listed]
                    listed, starts, stops = known[path]
                    for b in range(bisect_left(stops, key), bisect_right(starts, key)):
                        for column, value in zip(out, (key, path, *listed[b][2:]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "at", "length"])
        files.close()

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The captures of the keys wanted of each block."""
        files = Files()
        for batch in batches:
            for path, at, length, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = zlib.decompress(files.read(path, at, length), 31).decode().split("\n")
                out = []
                for key in keys:
                    k = bisect_left(block, key, key=lambda line: line.split("\t", 1)[0])
                    while k < len(block) and block[k].split("\t", 1)[0] == key:
                        out.append(block[k].split("\t"))
                        k += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[c] if c in (0, 2) else _number(r[c]) for r in out], pa.string() if c in (0, 2) else pa.int64()) for c in range(5)], names=["key", "page_id", "file", "at", "length"])
        files.close()

    keys = wanted.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    wanted_blocks = keys.mapInArrow(search, "key string, file string, at long, length long")
    # no more keys to a block than it has lines
    grouped = wanted_blocks.groupBy("file", "at", "length").agg(F.collect_list("key").alias("keys"))
    return grouped.mapInArrow(lines, "key string, page_id long, file string, at long, length long")


def fetch(captures: DataFrame, *, payload: bool = True, most: int = 8 << 20) -> DataFrame:
    """The records of the captures (file, at, length), read by byte ranges; ranges that adjoin are read at once, ``most`` bytes at a time."""
    schema = pa.schema(_FIELDS if payload else _FIELDS[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            start = 0
            while start < len(rows):
                path, low, _ = rows[start]
                stop, high, held = start, low, 0
                while stop < len(rows) and rows[stop][0] == path and high <= rows[stop][1] <= high + 4096 and held < most:
                    high = rows[stop][1] + rows[stop][2]
                    held = high - low
                    stop += 1
                view = memoryview(files.read(path, low, high - low))
                found = [parse(zlib.decompress(view[at - low : at - low + length], 31)) for _, at, length in rows[start:stop]]
                yield pa.RecordBatch.from_arrays([pa.array([f[name] for f in found], kind) for name, kind in zip(schema.names, schema.types, strict=True)], schema=schema)
                start = stop
        files.close()

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // most))
    dealt = captures.select("file", "at", "length").repartition(tasks, "file", F.floor(F.col("at") / F.lit(most))).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, ", ".join(f"{name} {kinds[str(kind)]}" for name, kind in zip(schema.names, schema.types, strict=True)))


def keys_of(urls: DataFrame) -> DataFrame:
    """(key) of each URL in ``urls`` (url)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(written_url(u)) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(run, "key string")


def lookup(spark: SparkSession, index: str, urls: DataFrame, *, payload: bool = True) -> DataFrame:
    """The records of all captures of the URLs in ``urls`` (url)."""
    return fetch(stash(find(spark, index, keys_of(urls)), "captures"), payload=payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and looked up by its URL in the capture index."""
    base, pages = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", table(spark, sf_dir, "pages")
    write_archive(pages, f"{base}/archive")
    write_index(spark, f"{base}/archive", f"{base}/index")
    return lookup(spark, f"{base}/index", pages.select("url"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
