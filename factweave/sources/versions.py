"""A relation whose versions stay readable: a base, and a log of changes with tombstones.

A commit writes the records that it adds and removes, each once, as one Parquet folder, and then a
line of the log, whose file must not exist yet: of two writers of one version the second fails, and a
folder without its line is of a commit that did not end.  Changes of like size are merged, the newest
word on a record counting; once they are a quarter of the base, a new base takes them in.  What was
merged stays, so each version is read from the fewest folders that cover it: a plan of one
base, one scan of changes and one anti-join, however many commits there were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kb import KbError, columns

#: Records that the driver gathers for one commit; more must come as a DataFrame.
STAGED_ROWS = 100_000
#: A new base is written once the changes beside it have this share of its rows.
BASE_SHARE = 0.25


@dataclass(frozen=True)
class Segment:
    """What versions ``first`` to ``last`` changed; a base, which holds facts only, begins with version 0."""

    first: int
    last: int
    folder: str
    rows: int


class VersionedRelation:
    def __init__(self, spark: SparkSession, path: str, arity: int):
        if arity < 1:
            raise KbError("a relation has one column at least")
        self.spark, self.path, self.arity = spark, path.rstrip("/"), arity
        self.segments = self._read_log()
        self.staged: dict[tuple[str, ...], bool] = {}

    # -- the log: one small file for each segment ----------------------------------------

    def _hadoop(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _read_log(self) -> list[Segment]:
        fs, log = self._hadoop(f"{self.path}/log")
        if not fs.exists(log):
            return []
        return sorted((Segment(**json.loads(r["value"])) for r in self.spark.read.text(f"{self.path}/log").collect()), key=lambda s: (s.last, s.first))  # one line each

    def _note(self, s: Segment) -> None:
        fs, path = self._hadoop(f"{self.path}/log/{s.first}-{s.last}")
        if fs.exists(path):
            raise KbError(f"version {s.last} is there already")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(asdict(s)).encode()))
        finally:
            out.close()
        self.segments = sorted([*self.segments, s], key=lambda s: (s.last, s.first))

    @property
    def version(self) -> int:
        """The last version; 0, which is empty, before the first commit."""
        return max((s.last for s in self.segments), default=0)

    # -- changes -------------------------------------------------------------------------

    def _stage(self, records: Iterable[Iterable[str]], kept: bool) -> None:
        rows = [tuple(map(str, r)) for r in records]
        if any(len(r) != self.arity for r in rows):
            raise KbError(f"records have {self.arity} columns")
        self.staged.update((r, kept) for r in rows)
        if len(self.staged) > STAGED_ROWS:
            raise KbError(f"more than {STAGED_ROWS} records are staged: commit them, or give a DataFrame")

    def add(self, records: Iterable[Iterable[str]]) -> None:
        """Stages records for the next commit; the last word on a record counts."""
        self._stage(records, True)

    def remove(self, records: Iterable[Iterable[str]]) -> None:
        self._stage(records, False)

    def commit(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Makes one version of what is staged, or of DataFrames, of which a record in both is added; returns its number."""
        parts = []
        if self.staged:
            parts.append(self.spark.createDataFrame([(*r, kept, 1) for r, kept in self.staged.items()], f"{self._schema}, kept boolean, word int"))
        for df, kept in ((removed, False), (added, True)):
            if df is not None:
                if len(df.columns) != self.arity:
                    raise KbError(f"records have {self.arity} columns")
                cells = df.toDF(*columns(self.arity)).select(*(F.col(c).cast("string").alias(c) for c in columns(self.arity))).dropna()
                parts.append(cells.withColumns({"kept": F.lit(kept), "word": F.lit(3 if kept else 2)}))
        version = self.version + 1
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            last = rows.groupBy(*columns(self.arity)).agg(F.max_by("kept", "word").alias("kept")).withColumn("version", F.lit(version).cast("long"))
            self._write(last, version, version)
            self.staged = {}
            self._merge()
        return self.version

    @property
    def _schema(self) -> str:
        return ", ".join(f"{c} string" for c in columns(self.arity))

    def _write(self, df: DataFrame, first: int, last: int) -> None:
        folder = f"{first}-{last}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        rows = self._scan([folder]).count()
        self._note(Segment(first, last, folder, rows))

    def _merge(self) -> None:
        while True:
            base, changes = self._cover(self.version)
            if changes and sum(s.rows for s in changes) >= BASE_SHARE * (base.rows if base else 0):
                version = self.version
                self._write(self.at(version).withColumns({"kept": F.lit(True), "version": F.lit(version).cast("long")}), 0, version)
                return
            if len(changes) < 2 or changes[-2].rows > 2 * changes[-1].rows:
                return
            a, b = changes[-2:]
            self._write(self._last(self._scan([a.folder, b.folder])), a.first, b.last)

    # -- versions ------------------------------------------------------------------------

    def _cover(self, version: int) -> tuple[Segment | None, list[Segment]]:
        """The newest base up to a version and the longest segments that lead from there to it."""
        bases = [s for s in self.segments if s.first == 0 and s.last <= version]
        base = max(bases, key=lambda s: s.last, default=None)
        at, changes, start = version, [], base.last if base else 0
        while at > start:
            fit = min((s for s in self.segments if s.last == at and s.first > start), key=lambda s: s.first, default=None)
            if fit is None:
                raise KbError(f"version {at} is missing")
            changes.append(fit)
            at = fit.first - 1
        return base, changes[::-1]

    def _scan(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self._schema}, kept boolean, version long").parquet(*(f"{self.path}/{f}" for f in folders))

    def _last(self, changes: DataFrame) -> DataFrame:
        word = changes.groupBy(*columns(self.arity)).agg(F.max(F.struct("version", "kept")).alias("w"))
        return word.select(*columns(self.arity), "w.kept", "w.version")

    def at(self, version: int | None = None) -> DataFrame:
        """The facts of a version, the last one by default."""
        version = self.version if version is None else version
        if not 0 <= version <= self.version:
            raise KbError(f"there is no version {version}")
        base, changes = self._cover(version)
        on = columns(self.arity)
        facts = self._scan([base.folder]).select(*on) if base else self.spark.createDataFrame([], self._schema)
        if not changes:
            return facts
        scan = self._scan([s.folder for s in changes])
        last = scan if len(changes) == 1 else self._last(scan)
        return facts.join(last.select(*on), on, "left_anti").unionByName(last.filter("kept").select(*on))

    def changed(self, old: int, new: int) -> DataFrame:
        """Records with ``kept``: the facts that came (true) and those that went from one version to a later one."""
        on = columns(self.arity)
        before, after = self.at(old), self.at(new)
        came, went = after.join(before, on, "left_anti"), before.join(after, on, "left_anti")
        return came.withColumn("kept", F.lit(True)).unionByName(went.withColumn("kept", F.lit(False)))
