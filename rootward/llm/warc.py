"""WARC archives of web pages: written, normalised and read back.

`write_archives` writes whole-file gzip streams, as a crawler that compresses its output
does: one gzip member over all records of a file. `normalise` inflates each file once as
a stream, rewrites every record as a gzip member of its own and writes beside each
archive a sidecar index (one JSON line per record: offset, length, page and type), so
that `read_records` can open any record by itself.

Of records with equal payloads that with the smallest page_id is a response, the others
are revisits of it, which hold no payload but its digest and length. Defined results: a
null html is an empty payload; a null page_id is kept, is a revisit if its payload has a
page_id and a response else; rows that repeat page_id and payload are all responses or
all revisits alike; a null url is written as `about:blank`; control characters and blanks
in urls are percent-encoded; an html of any length that a table cell can hold is one record,
which is rewritten and read back as a stream, never held whole; other columns are ignored; an
empty table gives empty archives and no rows.

Files are written under temporary names and then renamed, so tasks can be repeated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched, chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import batches, qualified, scratch, small_or_shuffled, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE, LEVEL, PIECE, END = 2000, 1, 1 << 18, b"\r\n\r\n"
#: Up to so many revisits are told to all tasks, which spares a shuffle of the pages.
REVISITS_TO_ALL = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, record_type string"


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 given in hex: 5 hex digits are 4 letters."""
    letters = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(sha1_hex, i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(ALPHABET), F.shiftright(bits, 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in (3, 2, 1, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """record: the text of each page's WARC record. Payloads under `least` bytes are never revisits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    slim = rows.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("size"))
    slim = written(slim.where(F.col("size") >= least), "digests")
    first = slim.groupBy("sha1").agg(F.min("page_id").alias("first"))
    again = slim.where("page_id is not null").join(first, "sha1").where("page_id > first").select("page_id", "sha1", "first").distinct()
    again = small_or_shuffled(written(again, "revisits"), REVISITS_TO_ALL)
    named = rows.where("page_id is not null").withColumn("sha1", F.sha1("html")).join(again, ["page_id", "sha1"], "left")
    unnamed = rows.where("page_id is null").withColumn("sha1", F.sha1("html")).join(first, "sha1", "left")
    columns = ["page_id", "url", "html", "sha1", "first"]
    full = named.select(*columns).unionByName(unnamed.select(*columns))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return full.select(F.concat(head, F.lit("\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, least: int = 0) -> None:
    """One gzip stream per file; what ends a line for the sink ends a record here."""
    sink = records(pages, least).write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
    sink.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is the version or status."""
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])}


class Stream:
    """Bytes of an iterator of pieces, taken a header or a number of bytes at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def head(self) -> bytes | None:
        """All up to an empty line, without it; None at the end."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                if self.held:
                    raise ValueError(f"{len(self.held)} bytes behind the last record")
                return None
            self.held += piece
        found = bytes(self.held[:end])
        del self.held[: end + 4]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            while not self.held:
                piece = next(self.pieces, None)
                if piece is None:
                    raise ValueError("the stream ends within a record")
                self.held += piece
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def inflated(file) -> Iterator[bytes]:
    """What an open gzip file of one or more members holds, a piece at a time."""
    stream, data = None, b""
    while data := data or file.read(PIECE):
        stream = stream or zlib.decompressobj(31)
        out = stream.decompress(data, PIECE)
        data, stream = (stream.unused_data, None) if stream.eof else (stream.unconsumed_tail, stream)
        if out:
            yield out
    if stream:
        raise ValueError("the gzip stream ends early")


class Section:
    """A part of an open file, to be read like a file."""

    def __init__(self, file, offset: int, length: int):
        file.seek(offset)
        self.file, self.left = file, length

    def read(self, n: int) -> bytes:
        found = self.file.read(min(n, self.left))
        self.left -= len(found)
        return found


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def members(file, out, level: int = LEVEL) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Write each record of an archive as a gzip member of its own; offset, length and fields of each.

    Neither the archive nor a record is ever held whole."""
    source, at = Stream(inflated(file)), 0
    while (head := source.head()) is not None:
        fields, member, length = fields_of(head), zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in chain([head, END], source.take(int(fields["content-length"]) + len(END))):
            done = member.compress(part)
            out.write(done)
            length += len(done)
        done = member.flush()
        out.write(done)
        yield at, length + len(done), fields
        at += length + len(done)


def normalise(source: str, target: str, spark, level: int = LEVEL) -> DataFrame:
    """Rewrite the archives of `source` into `target`; returns the index of all records.

    Spark lists the files and deals them out; tasks open them as streams."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, from_dir), (_, to_dir) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
        store.create_dir(to_dir, recursive=True)
        for path in chain.from_iterable(b.column("path").to_pylist() for b in parts):
            file = path.rsplit("/", 1)[1]
            name, temporary = file.removesuffix(".txt.gz") + ".warc.gz", f"{to_dir}/.{uuid.uuid4().hex}"
            # Not by its name: the stream is inflated here.
            with store.open_input_stream(f"{from_dir}/{file}", compression=None) as stored, store.open_output_stream(temporary, compression=None) as out, store.open_output_stream(temporary + ".index", compression=None) as index:
                found = ((name, at, length, _page(fields["warc-record-id"]), fields["warc-type"]) for at, length, fields in members(stored, out, level))
                for rows in batched(found, 1000):
                    index.write("".join(json.dumps(dict(zip(schema.names, r, strict=True))) + "\n" for r in rows).encode())
                    yield from batches(schema, [[list(c) for c in zip(*rows, strict=True)]])
            store.move(temporary, f"{to_dir}/{name}")
            store.move(temporary + ".index", f"{to_dir}/{name}.index")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    return written(files.select("path").mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, target: str) -> DataFrame:
    """A row per record of the index, each opened at its offset; a payload that does not
    have the digest that its header states stops the job."""
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(target)
        name, opened = None, None
        for batch in parts:
            rows = []
            for x in batch.to_pylist():
                if x["file"] != name:
                    name, opened = x["file"], store.open_input_file(f"{path}/{x['file']}")
                record = Stream(inflated(Section(opened, x["offset"], x["length"])))
                fields, http = fields_of(record.head()), record.head()
                digest, seen = fields["warc-payload-digest"].removeprefix("sha1:"), hashlib.sha1()
                for part in record.take(int(fields["content-length"]) - len(http) - len(END)):
                    seen.update(part)
                if fields["warc-type"] == "response" and digest != base64.b32encode(seen.digest()).decode():
                    raise ValueError(f"{name} at {x['offset']}: the payload does not have the stated digest")
                size = int(fields_of(http)["content-length"])
                rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields["warc-target-uri"]))
            yield from batches(schema, [[list(c) for c in zip(*rows, strict=True)]] if rows else [])

    return index.sortWithinPartitions("file", "offset").mapInArrow(run, out)


def round_trip(pages: DataFrame, least: int = 0, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write, normalise and read back; one row per page."""
    spark = pages.sparkSession
    source, target = (qualified(spark, scratch(spark, x)) for x in ("warc-raw", "warc"))
    write_archives(pages, source, records_per_file, least)
    return read_records(normalise(source, target, spark), target)
