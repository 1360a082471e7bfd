"""A corpus pipeline: toxicity filter, line dedup, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
All but the last return the columns of ``documents``; the last returns pieces of packed
sequences.  A document whose lines all occur earlier stays as an empty one until the
near-dedup stage, which keeps one empty document.

Null texts count as empty, and rows without an id come last wherever documents are ranked; of
repeated rows, and of rows of equal id, the first in place stays; texts of any length are taken
whole; empty tables give no rows; columns beside ``doc_id`` and ``text`` go along, whatever their
names, and ``n_chars`` is counted anew where a stage changes a text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factweave.llm import lines, packing, passages, simhash, toxicity
from factweave.llm.common import stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon, fitted on the labels of ``sf_dir``, scores as toxic."""
    return toxicity.filtered(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows of three lines out of later documents."""
    return lines.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of linked fingerprints."""
    return simhash.deduplicated(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of later documents."""
    return passages.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all that is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: Fingerprints and tokens are beyond SQL; the tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
