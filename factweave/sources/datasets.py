"""Named fact files, so that a run can ask for one by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators.kb import KbError, KnowledgeBase
from .facts import read_facts


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    short: str


@dataclass
class Registry:
    """Data sets by name and by short name."""

    sets: dict[str, Dataset] = field(default_factory=dict)

    def add(self, name: str, path: str, short: str | None = None) -> Dataset:
        found = Dataset(name, path, short or name)
        for key in {name, found.short}:
            if key in self.sets:
                raise KbError(f"data set {key} exists")
            self.sets[key] = found
        return found

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.sets:
            raise KbError(f"no data set {name}")
        return self.sets[name]

    @classmethod
    def from_file(cls, path: str) -> Registry:
        """Data sets from a file of lines ``name<TAB>path<TAB>short name``, the last optional."""
        out = cls()
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    out.add(*line.rstrip("\n").split("\t"))
        return out

    def load(self, spark: SparkSession, name: str) -> KnowledgeBase:
        d = self[name]
        return read_facts(spark, d.path, d.name)
