"""A Python data source for files of fixed-width rows, and for files of lines, in any folder that ``pyarrow.fs`` opens.

Reading: a file is cut into ranges of whole rows, one task each, so its size is bounded by no
task and no cell.  Writing: each task writes a part of its own with a name that no other attempt
has; only parts of attempts that ended well are named in the manifest, which the commit writes
last, and parts of others are deleted.  The folder format asks for one file a relation:
:func:`joined` then copies the named parts to their places in it, in tasks.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "factweave_rows"
#: Bytes of a range that one task reads.
RANGE_BYTES = 64 << 20
#: Bytes that are read, or copied, at once.
PIECE_BYTES = 4 << 20
#: What a folder of parts holds once it is whole.
MANIFEST = "_parts.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that tasks open what the driver means."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop)
    # the plain text of a path, in which nothing is escaped, where it is local
    return f"file://{found.toUri().getPath()}" if found.toUri().getScheme() == "file" else found.toString()


def local(path: str) -> bool:
    return path.startswith("file:")


@dataclass
class _Range(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, arity: int, range_bytes: int):
        self.path, self.arity, self.range_bytes = path, arity, range_bytes

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        width = 4 * self.arity
        end = fs.get_file_info(path).size // width * width  # a row that is cut short is left out
        step = max(1, self.range_bytes // width) * width
        return [_Range(a, min(a + step, end)) for a in range(0, end, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, path = _open(self.path)
        width, names = 4 * self.arity, [f"c{i}" for i in range(self.arity)]
        piece = max(1, PIECE_BYTES // width) * width
        with fs.open_input_file(path) as f:
            for at in range(partition.start, partition.stop, piece):
                size = min(piece, partition.stop - at)
                data = f.read_at(size, at)
                if len(data) < size:
                    raise OSError(f"{self.path} became shorter while it was read")
                cells = np.frombuffer(data, "<i4").reshape(-1, self.arity).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, i])) for i in range(self.arity)], names)


@dataclass
class _Part(WriterCommitMessage):
    task: int
    name: str
    bytes: int


class _Writer(DataSourceArrowWriter):
    """Parts in a folder: rows of numbers, or lines where ``lines`` is set."""

    def __init__(self, path: str, lines: bool):
        self.path, self.lines = path, lines

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        name, size = f"part-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                data = _lines(batch) if self.lines else _rows(batch)
                out.write(data)
                size += len(data)
        return _Part(TaskContext.get().partitionId(), name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _open(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        kept = {m.name for m in parts}
        for found in fs.get_file_info(pafs.FileSelector(path)):
            if found.base_name.startswith("part-") and found.base_name not in kept:  # of an attempt that failed or was not needed
                fs.delete_file(found.path)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([[m.name, m.bytes] for m in parts if m.bytes]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)


class RowsSource(DataSource):
    """Options: ``path``; for reading ``arity`` and ``rangeBytes``; for writing ``lines``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"c{i} bigint" for i in range(int(self.options["arity"])))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["arity"]), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("lines", "false") == "true")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # a local path may hold characters that a URI would escape
    return (pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)) if local(path) else opened(path)


def _rows(batch: pa.RecordBatch) -> bytes:
    cells = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.empty((0, 1))
    if cells.size and not (cells.min() >= -(2**31) and cells.max() < 2**31):
        raise ValueError("a number needs more than 32 bits, which the format does not have")
    return cells.astype("<i4").tobytes()


def _lines(batch: pa.RecordBatch) -> bytes:
    return "".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()


_lock = threading.Lock()


def _register(spark: SparkSession) -> None:
    """Once for each session: a further time would take the source away from threads that use it."""
    with _lock:
        if spark.conf.get("spark.factweave.rows", None) is None:
            spark.dataSource.register(RowsSource)
            spark.conf.set("spark.factweave.rows", "registered")


def read_rows(spark: SparkSession, path: str, arity: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``c0 .. c{n-1}`` (long) of a file of little-endian 32-bit numbers."""
    _register(spark)
    return spark.read.format(NAME).option("path", qualified(spark, path)).option("arity", arity).option("rangeBytes", range_bytes).load()


def write_parts(df: DataFrame, folder: str, lines: bool = False) -> list[tuple[str, int]]:
    """Writes ``df`` in parts; names and sizes of those that count, in the order of partitions.

    A folder without a manifest is of a write that did not end.
    """
    spark = df.sparkSession
    _register(spark)
    folder = qualified(spark, folder)
    df.write.format(NAME).mode("append").option("path", folder).option("lines", str(lines).lower()).save()
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return [tuple(x) for x in json.loads(f.read())]


def joined(spark: SparkSession, folder: str, parts: list[tuple[str, int]], target: str) -> None:
    """Parts as one file, which appears under its name when it is whole.

    On a mounted file system each task copies parts to their places, which may be done twice.
    Where files are only ever appended to, one task streams the parts, a piece at a time; the
    driver sees sizes only.
    """
    folder, target = qualified(spark, folder), qualified(spark, target)
    fs, path = _open(target)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    at, rows = 0, []
    for name, size in parts:
        rows.append((name, at, size))
        at += size
    if local(target):
        with fs.open_output_stream(part):
            pass
        if rows:
            plan = spark.createDataFrame(rows, "name string, at long, size long").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
            _run(plan.mapInPandas(_copier(folder, part), "size long"), at)
    else:
        _run(spark.range(1).coalesce(1).mapInPandas(_streamer(folder, target.rsplit("/", 1)[0] + "/" + part.rsplit("/", 1)[1], [r[0] for r in rows]), "size long"), at)
    fs.move(part, path)


def _run(df: DataFrame, size: int) -> None:
    found = df.agg(F.sum("size")).first()[0] or 0
    if found != size:
        raise OSError(f"{found} bytes were copied, not {size}")


def _pieces(f) -> Iterator[bytes]:
    while data := f.read(PIECE_BYTES):
        yield data


def _copier(folder: str, target: str):
    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _open(folder)
        for frame in frames:
            for name, at in zip(frame["name"], frame["at"], strict=True):
                done = 0
                with fs.open_input_stream(f"{path}/{name}") as f, open(target, "r+b") as out:
                    out.seek(int(at))
                    for data in _pieces(f):
                        done += out.write(data)
                yield pd.DataFrame({"size": [done]})

    return copy


def _streamer(folder: str, target: str, names: list[str]):
    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            done = 0
            fs, path = _open(folder)
            to, own = _open(target)
            with to.open_output_stream(own) as out:
                for name in names:
                    with fs.open_input_stream(f"{path}/{name}") as f:
                        for data in _pieces(f):
                            done += out.write(data) or len(data)
            yield pd.DataFrame({"size": [done]})

    return stream


def placed(spark: SparkSession, folder: str, parts: list[tuple[str, int]], target: str) -> None:
    """Parts as files of their own, numbered from 1 in place of the braces in ``target``."""
    folder, target = qualified(spark, folder), qualified(spark, target)
    fs, path = _open(folder)
    to = _open(target)[1]
    parent, _, name = to.rpartition("/")
    fs.create_dir(parent, recursive=True)
    earlier = re.compile(re.escape(name).replace(re.escape("{}"), r"\d+"))
    for found in fs.get_file_info(pafs.FileSelector(parent)):
        if earlier.fullmatch(found.base_name):
            fs.delete_file(found.path)
    for i, (name, _) in enumerate(parts, 1):
        fs.move(f"{path}/{name}", to.replace("{}", str(i)))


def dropped(spark: SparkSession, folder: str) -> None:
    fs, path = _open(qualified(spark, folder))
    fs.delete_dir(path)
