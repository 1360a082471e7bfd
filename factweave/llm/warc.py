"""Operator 12: web archives (WARC 1.1) written, normalised to one gzip member a record, and read by index.

Pages become ``response`` records, and ``revisit`` records where another page has the same payload of
some size already.  Spark's text sink writes them as archives that are one gzip stream each, as many
crawlers' archives are.  Such a file has no place to begin at but its first byte.

The normaliser therefore inflates a file once, from front to end and in pieces, and finds the records by
their lengths.  It writes each as a gzip member of its own, and beside the new archive a sidecar
index, one line a record with its offset and length.  Neither a file nor a record is held whole.
Readers then take ranges of the index: a large archive is read by many tasks, each of which seeks to its members.

Tasks write to files of new names, and the index that Spark commits says which of them count; files of
attempts that failed are deleted after the job.  Archives are opened through ``pyarrow.fs``,
which must know the scheme of the shared folder.

Results: a null payload is an empty one, very long ones are streamed; equal payloads of at least ``least``
bytes revisit the one with the largest id, of equal ids the first in place, rows without an id are
smallest; every row has a record, repeated ones too; an empty table gives no rows; other columns,
whatever their names, are not read.  A file that ends within a record or holds anything else than
records is an error that names it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import done_with, release, scratch
from .common import attached, prepare, scanned, spread_join, stage, text_of

#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 1000
#: When the pages were taken; the tables do not say.
DATE = "2024-01-01T00:00:00Z"
#: Bytes read, inflated or written at a time; of an archive, bytes that one task reads back; of a record's headers, at most.
PIECE, SPLIT_BYTES, HEADER_BYTES = 1 << 20, 4 << 20, 1 << 20
END = "\r\n\r\n"
_GZIP = 31  # zlib's window bits for a gzip member


def digests(pages: DataFrame) -> DataFrame:
    """``_rid, id, n`` (bytes) and ``key`` (equal for equal payloads) of the rows ``_rid, id, url, payload``."""
    key = F.concat_ws(":", F.sha1("payload"), F.hex(F.xxhash64("payload")), F.octet_length("payload"))
    return pages.select("_rid", "id", F.octet_length("payload").cast("long").alias("n"), key.alias("key"))


def revisits(found: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``_rid`` of the rows that repeat a payload, with ``to_id`` and ``to_rid`` of the row that has it."""
    large = found.filter(F.col("n") >= least).select("_rid", "id", "key")
    groups = large.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("id", (-F.col("_rid")).alias("back"))).alias("first")).filter("n > 1")
    staged = stage(groups.select("key", "n", F.col("first.id").alias("to_id"), (-F.col("first.back")).alias("to_rid")), "warc-groups")
    return spread_join(large, staged, "key").filter("_rid <> to_rid").select("_rid", "to_id", "to_rid")


def record_id(id_, rid):
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), rid.cast("string"), F.lit(">"))


def records(pages: DataFrame, found: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: a record for each row of ``_rid, id, url, payload``, without the two line ends that close it."""
    again = F.col("to_rid").isNotNull()
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.octet_length("payload"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        named("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        named("WARC-Record-ID", record_id(F.col("id"), F.col("_rid"))),
        F.lit(f"WARC-Date: {date}"),
        named("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.lit("Content-Type: application/http; msgtype=response"),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        F.when(again, F.concat_ws("\r\n", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("WARC-Truncated: length"), named("WARC-Refers-To", record_id(F.col("to_id"), F.col("to_rid"))))),
        named("Content-Length", size.cast("string")),
    )
    return attached(pages, found, "warc-revisits").select(F.concat(head, F.lit(END), block).alias("value"))


def write_monolithic(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Archives of one gzip stream each, one for each partition of ``pages``, in the folder ``path``."""
    prepare(pages.sparkSession)
    rows = scanned(pages).select(F.monotonically_increasing_id().alias("_rid"), F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text_of(payload).alias("payload"))
    facts = stage(digests(rows), "warc-digests")
    records(rows, revisits(facts, least), date).write.option("compression", "gzip").option("lineSep", END).text(path)
    done_with(facts)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip data, of one member or of several, holds."""
    member, ended = zlib.decompressobj(_GZIP), True
    for piece in pieces:
        while piece:
            if ended:
                member, ended = zlib.decompressobj(_GZIP), False
            out = member.decompress(piece, PIECE)
            if out:
                yield out
            ended, piece = member.eof, member.unused_data if member.eof else member.unconsumed_tail
    while not ended and (out := member.decompress(member.unconsumed_tail, PIECE)):
        yield out
    if not ended and not member.eof:
        raise ValueError("the stream ends within a gzip member")


class Stream:
    """Reads lines' ends and lengths from pieces of bytes, of which it holds one or two."""

    def __init__(self, pieces: Iterator[bytes]):
        self._pieces, self._held = pieces, b""

    def _more(self) -> bool:
        piece = next(self._pieces, b"")
        self._held += piece
        return bool(piece)

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to and with ``mark``; nothing at the end."""
        while (at := self._held.find(mark)) < 0:
            if len(self._held) > most or not self._more():
                if not self._held:
                    return b""
                raise ValueError("a record's headers do not end")
        out, self._held = self._held[: at + len(mark)], self._held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self._held and not self._more():
                raise ValueError("a record is cut off")
            out, self._held = self._held[:n], self._held[n:]
            n -= len(out)
            yield out


def headers_of(head: bytes) -> dict[str, str]:
    """The named fields of a record, or of the HTTP response in it; names in small letters."""
    lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def record_heads(stream: Stream) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """Each record's header bytes, fields and block length; the block and its end must be taken before the next."""
    end = END.encode()
    while head := stream.until(end, HEADER_BYTES):
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:20]!r}")
        fields = headers_of(head)
        yield head, fields, int(fields["content-length"])


def _read_pieces(file) -> Iterator[bytes]:
    while piece := file.read(PIECE):
        yield piece


INDEX = "file string, number long, offset long, length long, record_id string, record_type string"


def normalised_file(source: str, folder: str) -> Iterator[dict]:
    """Rewrites one archive into ``folder`` with a member for each record, and a sidecar index; rows of the index."""
    fs, path = _open(source)
    to_fs, to_folder = _open(folder)
    name = f"{re.sub(r'[.](txt|warc)?[.]?gz$', '', path.rsplit('/', 1)[-1])}-{uuid.uuid4().hex}.warc.gz"
    rows, offset, end = [], 0, END.encode()
    try:
        with fs.open_input_stream(path, compression=None) as file, to_fs.open_output_stream(f"{to_folder}/{name}", compression=None) as out, to_fs.open_output_stream(f"{to_folder}/{name}.index", compression=None) as index:
            stream = Stream(inflated(_read_pieces(file)))
            for number, (head, fields, length) in enumerate(record_heads(stream)):
                packer, at = zlib.compressobj(6, zlib.DEFLATED, _GZIP), offset
                offset += out.write(packer.compress(head))
                for piece in stream.take(length):
                    offset += out.write(packer.compress(piece))
                if b"".join(stream.take(len(end))) != end:
                    raise ValueError("a record is longer than it says")
                offset += out.write(packer.compress(end) + packer.flush())
                row = {"file": f"{folder}/{name}", "number": number, "offset": at, "length": offset - at, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type")}
                index.write((json.dumps(row) + "\n").encode())
                rows.append(row)
                if len(rows) == 1000:
                    yield from rows
                    rows = []
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"{source}: {e}") from e
    yield from rows


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """All archives in the folder ``source`` rewritten into ``folder``; the index (:data:`INDEX`), staged.

    A file is one task's work, as a stream cannot be entered in the middle; files go to tasks by size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held = []
                for row in normalised_file(path, folder):
                    held.append(row)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    index = stage(files.mapInArrow(run, INDEX), "warc-index")
    fs, path = _open(folder)
    good = {r["file"].rsplit("/", 1)[-1] for r in index.select("file").distinct().collect()}  # names of files, not of records
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.removesuffix(".index") not in good:
            fs.delete_file(info.path)
    return index


def sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The index as the sidecar files of a folder of normalised archives have it."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index").json(folder)


RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def record(stream: Stream, keep: bool) -> tuple:
    """One record (:data:`RECORDS`); a payload that does not have the digest it claims is an error."""
    head, fields, length = next(record_heads(stream))
    left, http = length, b""
    if fields.get("content-type", "").startswith("application/http") and length:
        http = stream.until(END.encode(), HEADER_BYTES)
        left -= len(http)
    kind, digest, size, kept = fields.get("warc-type"), hashlib.sha1(), 0, []
    for piece in stream.take(left):
        digest.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size, found = int(headers_of(http).get("content-length", 0)), claimed
    elif claimed and claimed != (found := digest.hexdigest()):
        raise ValueError(f"{fields.get('warc-record-id')}: the payload is not the one of its digest")
    else:
        found = digest.hexdigest()
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), found, size, b"".join(kept) if keep and kind != "revisit" else None


def read(index: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records (:data:`RECORDS`) that rows of an index point to; ``payload`` is null for revisits, and for all without ``payloads``."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, held, size = None, None, [], 0
        for batch in batches:
            for wanted, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if wanted != name:
                    if file is not None:
                        file.close()
                    fs, path = _open(wanted)
                    name, file = wanted, fs.open_input_file(path)
                file.seek(offset)
                held.append(record(Stream(inflated(_member(file, length))), payloads))
                size += len(held[-1][-1] or b"") + 100
                if size > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    share = F.floor(F.col("offset") / split_bytes)
    placed = index.select("file", "offset", "length").repartition("file", share).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, RECORDS)


def _member(file, length: int) -> Iterator[bytes]:
    while length:
        piece = file.read(min(length, PIECE))
        if not piece:
            raise ValueError("the archive is shorter than its index says")
        length -= len(piece)
        yield piece


def page_of(column: str):
    """The page's id in a record's id; null for rows that had none."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+):\d+>$", 1).try_cast("long")


def round_trip(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, payloads: bool = False) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of every row, as the normalised archives say."""
    spark = pages.sparkSession
    whole, folder = scratch(spark, "warc-whole"), scratch(spark, "warc")
    write_monolithic(pages, whole, id_column, url, payload, least)
    index = normalise(spark, whole, folder)
    release(whole)
    out = read(index, payloads)
    return out.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), *(["payload"] if payloads else []))


SQL = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS h FROM pages
    ), m AS (
        SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM p
    )
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM m
"""
