"""The folder that all nodes see, where intermediate tables and checkpoints go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster has no folder that all of its nodes see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves as long as driver and executors are one
    process; on a cluster each executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all nodes see")
        found = "file://" + tempfile.mkdtemp(prefix="factweave-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with :func:`release`, or when the driver ends."""
    path = f"{shared_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made[path] = spark
    return path


def release(path: str) -> None:
    """Deletes what was written to a path of :func:`scratch`."""
    spark = _made.pop(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    What follows survives lost executors without running ``df`` again, reads the columns that it
    needs, and is planned by the size that was written.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factweave_path = path
    return out


def written_in(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A frame that :func:`written` gave, read in another session."""
    return spark.read.schema(df.schema).parquet(df._factweave_path)


def done_with(df: DataFrame) -> None:
    """Deletes the files of a frame that :func:`written` gave; nothing that reads them may run any more."""
    release(df._factweave_path)


def _forget() -> None:
    for path in list(_made):
        try:
            release(path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
