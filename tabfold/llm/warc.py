"""WARC archives written from, and read as, a table of chunks.

A record is a run of rows (record, chunk number, bytes): payloads longer than ``CHUNK_BYTES`` are several rows,
so no task holds a whole one.  Digests travel with the rows: each chunk carries the length and the SHA-1 of the
payload up to its end, and the last one those of the whole.  Heads are rows before the first chunk; sorted by
record and chunk, rows are exactly what the archive holds, in order.

Archives are files of gzip members, one a record, beside a manifest of their segments.  A task writes to a name of its own
and the manifest lists what finished tasks wrote, so repeated or lost tasks leave no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabfold.llm import duck
from tabfold.llm.arrays import short_batches
from tabfold.operators.joins import join_popular, popular
from tabfold.workspace import new_folder, stage

CHUNK_BYTES = 1 << 16
#: Compressed bytes of an archive after which a task begins another, and of a part of one that is read by itself.
ARCHIVE_BYTES = 1 << 30
SEGMENT_BYTES = 1 << 23
BLOCK_BYTES = 1 << 20
LEVEL = 5

#: Names that the format fixes.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAME = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "archive string, record_id string, type string, target string, refers_to string, digest string,"
    " chunk long, last boolean, bytes_so_far long, sha1_so_far string, data binary"
)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path inside it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


# --- the table of chunks


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``bytes_so_far`` and ``sha1_so_far``; the chunks of a record follow one another."""
    size, state = 0, hashlib.sha1()
    for batch in batches:
        lengths, digests = [], []
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
            if chunk == 0:
                size, state = 0, hashlib.sha1()
            part = data.as_buffer()
            state.update(part)
            size += part.size
            lengths.append(size)
            digests.append(state.digest())
        columns = [*batch.columns, pa.array(lengths, pa.int64()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "bytes_so_far", "sha1_so_far"])


def chunk_table(
    pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``record, key, url, chunk, last, data, bytes_so_far, sha1_so_far``, written once so that record numbers stay.

    A text is its UTF-8 bytes, null is empty; an empty payload is one empty chunk.
    """
    spark = pages.sparkSession
    short_batches(spark)
    size = F.greatest(F.expr(f"(octet_length(payload) + {chunk_bytes} - 1) div {chunk_bytes}"), F.lit(1).cast("long"))
    rows = pages.select(
        F.col(key_col).cast("string").alias("key"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.select(F.monotonically_increasing_id().alias("record"), "*", size.alias("chunks"))
    rows = rows.select("*", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"))
    rows = rows.select(
        "record",
        "key",
        "url",
        "chunk",
        (F.col("chunk") == F.col("chunks") - 1).alias("last"),
        F.expr(f"substring(payload, cast(chunk * {chunk_bytes} + 1 AS int), {chunk_bytes})").alias("data"),
    )
    schema = "record long, key string, url string, chunk long, last boolean, data binary, bytes_so_far long, sha1_so_far binary"
    path = new_folder(spark, "chunks")
    rows.mapInArrow(_carried, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def heads(chunks: DataFrame, key_type: str, fewest_bytes: int = 0) -> DataFrame:
    """A row for each record: ``record, key, url, bytes, sha1, first_record, first_key, first_url``.

    Of records with equal payloads (length and SHA-1) of at least ``fewest_bytes``, that with the smallest key (null
    last, then the smallest record) is the first; the ``first_`` columns are set for all others.
    """
    whole = stage(
        chunks.where("last").select("record", "key", "url", F.col("bytes_so_far").alias("bytes"), F.col("sha1_so_far").alias("sha1")),
        "payloads",
    )
    order = F.struct(F.col("key").isNull(), F.col("key").cast(key_type), "record", "key", "url")
    copies = whole.where(F.col("bytes") >= fewest_bytes).groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
    copies = stage(copies.where("copies > 1"), "copies")
    again = join_popular(whole, copies, ["sha1", "bytes"], popular(F.col("copies"), whole.count()))
    again = again.where("record <> first.record").select(
        "record",
        F.col("first.record").alias("first_record"),
        F.col("first.key").alias("first_key"),
        F.col("first.url").alias("first_url"),
    )
    return whole.join(again, "record", "left")


# --- writing


def _record_name(record: int, key: str | None) -> str:
    return f"<{RECORD_NAME}{record}" + ("" if key is None else f":{quote(key, safe='')}") + ">"


def key_of(name: str) -> Column:
    """SQL for the key inside a record name column, null where there is none."""
    part = f"substring_index(substring({name}, {len(RECORD_NAME) + 2}, length({name}) - {len(RECORD_NAME) + 2}), ':', -1)"
    return F.when(F.expr(f"instr(substring({name}, {len(RECORD_NAME) + 2}), ':') > 0"), F.url_decode(F.expr(part)))


def _target(url: str | None, name: str) -> str:
    return name[1:-1] if not url else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _head(row: dict, date: str) -> bytes:
    """The head of a record and of the reply inside it."""
    name = _record_name(row["record"], row["key"])
    revisit = row["first_record"] is not None
    http = _http_head(row["bytes"])
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(row['url'], name)}",
        f"WARC-Payload-Digest: sha1:{_base32(row['sha1'])}",
    ]
    if revisit:
        first = _record_name(row["first_record"], row["first_key"])
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first}", f"WARC-Refers-To-Target-URI: {_target(row['first_url'], first)}", f"WARC-Refers-To-Date: {date}"]
    size = len(http) + (0 if revisit else row["bytes"])
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode() + http


def _info(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    lines = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Archive:
    """One open file of gzip members and the segments of it that are complete."""

    def __init__(self, folder: str, date: str):
        store, path = _store(folder)
        store.create_dir(path)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.file = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
        self.start, self.records, self.member = 0, 0, None
        self.begin(_info(date))
        self.end(b"")

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.file.write(self.member.compress(head))

    def add(self, data) -> None:
        self.file.write(self.member.compress(data))

    def end(self, tail: bytes = b"\r\n\r\n") -> None:
        self.file.write(self.member.compress(tail) + self.member.flush())
        self.member = None
        self.records += 1

    def segment(self) -> tuple[str, int, int, int]:
        done = (self.path, self.start, self.file.tell(), self.records)
        self.start, self.records = done[2], 0
        return done


def _written(folder: str, date: str):
    """Task that writes sorted rows of heads and chunks and tells the segments written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segments, skip = None, [], False

        def close_record() -> None:
            if archive is not None and archive.member is not None:
                archive.end()
                if archive.file.tell() - archive.start >= SEGMENT_BYTES:
                    segments.append(archive.segment())

        for batch in batches:
            data = batch.column("data")
            named = batch.drop_columns(["data"]).to_pylist()
            for i, row in enumerate(named):
                if row["chunk"] < 0:
                    close_record()
                    if archive is not None and archive.file.tell() >= ARCHIVE_BYTES:
                        segments.append(archive.segment())
                        archive.file.close()
                        archive = None
                    archive = archive or _Archive(folder, date)
                    archive.begin(_head(row, date))
                    skip = row["first_record"] is not None
                elif not skip:
                    archive.add(data[i].as_buffer())
        close_record()
        if archive is not None:
            segments.append(archive.segment())
            archive.file.close()
        columns = list(zip(*segments)) or [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "start", "stop", "records"])

    return task


def write_archives(chunks: DataFrame, first: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes the records of ``chunk_table`` under the decisions of ``heads``; returns the manifest.

    The manifest has ``archive, start, stop, records`` for each segment: a range of whole gzip members.
    """
    head = first.select("record", F.lit(-1).cast("long").alias("chunk"), "key", "url", "bytes", "sha1", "first_record", "first_key", "first_url")
    body = chunks.select("record", "chunk", "data")
    rows = head.unionByName(body, allowMissingColumns=True).repartition("record").sortWithinPartitions("record", "chunk")
    manifest = rows.mapInArrow(_written(folder, date), "archive string, start long, stop long, records long")
    return stage(manifest, "manifest")


# --- reading


class _Bytes:
    """Decompressed bytes of a range of a file, a block at a time."""

    def __init__(self, path: str, start: int, stop: int | None):
        store, inner = _store(path)
        self.file = store.open_input_file(inner)
        self.left = (self.file.size() if stop is None else stop) - start
        self.file.seek(start)
        self.raw, self.zip, self.held = b"", None, bytearray()
        self.fill_raw()
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def fill_raw(self) -> None:
        self.raw = self.file.read(min(BLOCK_BYTES, self.left)) if self.left > 0 else b""
        self.left -= len(self.raw)

    def more(self) -> bool:
        """Holds another block; false at the end."""
        while True:
            if not self.raw:
                self.fill_raw()
                if not self.raw:
                    if self.packed and self.zip is not None:
                        raise ValueError("an archive ends inside a record")
                    return False
            if not self.packed:
                self.held += self.raw
                self.raw = b""
                return True
            self.zip = self.zip or zlib.decompressobj(31)
            out = self.zip.decompress(self.raw, BLOCK_BYTES)
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data, None
            else:
                self.raw = self.zip.unconsumed_tail
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; null when nothing is left."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a head")
                return None
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a head in lower case; the first line is under the empty name."""
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {"": lines[0]} | {name.strip().lower(): value.strip() for name, _, value in pairs}


def _records(path: str, start: int, stop: int | None, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of ``RECORD_SCHEMA``, a chunk at a time."""
    source = _Bytes(path, start, stop)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"no record begins where one should: {path}")
        left = int(fields["content-length"])
        kind, told = fields.get("warc-type"), None
        if fields.get("content-type", "").startswith("application/http") and left:
            inner = source.until(b"\r\n\r\n")
            left -= len(inner)
            told = _fields(inner).get("content-length")
        about = (path, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"))
        size, state, chunk = 0, hashlib.sha1(), 0
        while True:
            data = source.take(min(chunk_bytes, left))
            left -= len(data)
            size += len(data)
            state.update(data)
            if kind == "revisit" and told is not None and left == 0:
                size = int(told)  # the payload is that of the record it refers to
            yield (*about, chunk, left == 0, size, None if kind == "revisit" else _base32(state.digest()), data)
            chunk += 1
            if left == 0:
                break
        source.take(4)


def _read(chunk_bytes: int, with_data: bool):
    names = [part.split()[0] for part in RECORD_SCHEMA.split(",")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments in batches:
            for part in segments.to_pylist():
                rows, held = [], 0
                for row in _records(part["archive"], part["start"], part["stop"], chunk_bytes):
                    rows.append(row if with_data else (*row[:-1], None))
                    held += len(row[-1]) if with_data else 0
                    if held >= 4 * BLOCK_BYTES or len(rows) >= 1000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return task


def read_archives(segments: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunks of all records: ``RECORD_SCHEMA``, in archive order within a segment.

    ``segments`` is a manifest, or ``archives_in`` a folder.  ``bytes_so_far`` and ``sha1_so_far`` of the last chunk are
    those of the whole payload; a revisit has the length its head tells and no SHA-1 of its own.  Without
    ``with_data`` the bytes are digested and not returned.  A file that breaks off or is none is an error.
    """
    spread = segments.select("archive", "start", "stop").repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(_read(chunk_bytes, with_data), RECORD_SCHEMA)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of a folder, compressed or not, each one segment; their bytes are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.col("path").alias("archive"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))


def archive_pages(
    pages: DataFrame, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", fewest_bytes: int = 0, folder: str | None = None
) -> DataFrame:
    """Writes a record for every page and returns the manifest; see ``heads`` for which are revisits.

    Nulls: an empty payload, no address, no key (such records sort behind the others).  Repeated rows are records of their
    own.  An empty table gives an empty manifest and no file.  Other columns are ignored.
    """
    chunks = chunk_table(pages, key_col, url_col, payload_col)
    first = heads(chunks, pages.schema[key_col].dataType.simpleString(), fewest_bytes)
    return write_archives(chunks, first, folder or new_folder(pages.sparkSession, "warc"))


def round_trip(pages: DataFrame, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", fewest_bytes: int = 0) -> DataFrame:
    """Writes pages to archives, reads these and tells what they hold, a row for each page.

    ``key, payload_bytes, payload_digest, record_type, refers_to``; length and digest of responses are measured on the
    bytes read and those of revisits read from their heads.
    """
    manifest = archive_pages(pages, key_col=key_col, url_col=url_col, payload_col=payload_col, fewest_bytes=fewest_bytes)
    held = read_archives(manifest, with_data=False).where("last AND type IN ('response', 'revisit')")
    kind = pages.schema[key_col].dataType
    return held.select(
        key_of("record_id").cast(kind).alias(key_col),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.coalesce("sha1_so_far", F.expr("substring_index(digest, ':', -1)")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        key_of("refers_to").cast(kind).alias("refers_to"),
    )


def round_trip_sql(fewest_bytes: int = 0) -> str:
    """DuckDB SQL of ``round_trip`` over ``pages`` with distinct ids."""
    return f"""
WITH digested AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digits FROM pages),
firsts AS (
    SELECT *, CASE WHEN payload_bytes >= {fewest_bytes}
              THEN min(page_id) OVER (PARTITION BY digits, payload_bytes) ELSE page_id END AS first
    FROM digested)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {duck.base32("digits")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
