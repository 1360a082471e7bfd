"""Small helpers shared by the operators: table reading, staging and batch slicing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of text that a Python worker holds as one working slice of an Arrow batch.
SLICE_BYTES = 8 << 20
#: Short rows that make a file of a staged table worthwhile.
STAGED_ROWS = 200_000
#: Cells of a table (some 20 bytes each) that may be broadcast.
BROADCAST_CELLS = 400_000

#: Settings of the session that the operators ask for, where nobody has set them.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def prepare(spark: SparkSession) -> None:
    """Small batches, and the package on the path of local Python workers.

    Texts are long: a batch of the scan's 4096 rows is one huge array for each column, and
    an Arrow batch is held several times on its way to Python and back, outside the heap too.
    The settings are the session's, as plans read them when they run; what the caller has set stays.
    Elsewhere than on the driver's machine the package comes with ``--py-files``.
    """
    given = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, rows: int | None = None, compact: bool = False) -> DataFrame:
    """``df`` written into the shared folder and read back; see :func:`sources.shared.written`.

    Row identifiers made before it stay as they are.  Where about how many ``rows`` (short
    ones) it has is known, small ones make few files.  ``compact`` is for tables far smaller than
    what they are made from: they are gathered to files of the advisory size, not one for each task.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // STAGED_ROWS)
    if compact:
        df = df.hint("rebalance")
    prepare(df.sparkSession)
    return written(df, name)


_SCANS = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "LogicalRDD", "Range"}


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if its plan only reads, filters and projects, so that it gives its rows in the same places each time; else a staged copy.

    Rows behind a shuffle may come in another order, or in other partitions, when a plan runs again.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in _SCANS and node.children().size() == 1:
        node = node.children().apply(0)
    return df if node.nodeName() in _SCANS else stage(df, "rows")


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Rows numbered by partition and place, the same each time the plan runs."""
    return scanned(df).withColumn(name, F.monotonically_increasing_id())


def boxed(documents: DataFrame) -> DataFrame:
    """``_row`` (all columns, so that none can clash with a helper), ``_rid`` (see :func:`with_row_id`), ``doc_id`` and ``text`` (null as empty)."""
    prepare(documents.sparkSession)
    return scanned(documents).select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_rid"), "doc_id", text_of().alias("text"))


def unboxed(rows: DataFrame, text=None) -> DataFrame:
    """The columns in ``_row``; with ``text`` given, that replaces theirs and ``n_chars``, if there, is counted anew."""
    row = F.col("_row")
    fields = {f.name: f for f in rows.schema["_row"].dataType.fields}
    if text is not None:
        row = row.withField("text", text.cast(fields["text"].dataType))
        if "n_chars" in fields:
            row = row.withField("n_chars", F.length(text).cast(fields["n_chars"].dataType))
    return rows.select(row.alias("_row")).select("_row.*")


def attached(rows: DataFrame, found: DataFrame, name: str, how: str = "left", lists: str | None = None) -> DataFrame:
    """``rows`` joined on ``_rid`` with what was found for some of them, so that texts need not be shuffled while that is little.

    ``found`` is staged and its cells (rows, and entries of the column ``lists``) counted;
    at most BROADCAST_CELLS of them are broadcast, more are joined by a shuffle.
    """
    staged = stage(found, name)
    cells = F.count("*") + (F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0))
    small = staged.agg(cells).first()[0] <= BROADCAST_CELLS
    return rows.join(F.broadcast(staged) if small else staged, "_rid", how)


def spread_join(rows: DataFrame, found: DataFrame, key: str, bound: int = 50_000) -> DataFrame:
    """``rows`` joined with a staged table that has each ``key`` once, and in ``n`` how many of the rows have it.

    Keys with more than one in ``bound`` of all those rows are fewer than ``bound``; they are broadcast, so
    their rows stay where they are, however many one key has.  The rest is joined by a shuffle.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    bar = max(1000, total // bound)
    hot, cold = found.filter(F.col("n") > bar).drop("n"), found.filter(F.col("n") <= bar).drop("n")
    if not found.filter(F.col("n") > bar).limit(1).count():
        return rows.join(cold, key)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    names = [c for c in found.columns if c not in (key, "n")]
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key)
    return marked.filter("_hot").select(*rows.columns, *names).unionByName(rest.select(*rows.columns, *names))


def text_of(column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(sizes, dtype=np.int64)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch
