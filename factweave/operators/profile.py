"""Profiles of a knowledge base: frequent constants, similar columns, statistics and splits."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import tarjan
from .grouped import Grouped
from .kb import KnowledgeBase, cut_lineage, union


def value_counts(kb: KnowledgeBase) -> DataFrame:
    """``rel, pos, val, n``."""
    return kb.value_counts()


def sizes(kb: KnowledgeBase) -> DataFrame:
    return union(kb.size(n).select(F.lit(n).alias("rel"), F.lit(kb.arity(n)).alias("arity"), F.col("n").alias("total")) for n in kb.names)


def promising_constants(kb: KnowledgeBase, coverage: float = 0.25, strict: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """``rel, pos, val, n`` with ``n >= ceil(coverage * total)``, or ``n > floor(coverage * total)`` if strict.

    ``counts`` are the :func:`value_counts`, where somebody has them already; so below.
    """
    counts = value_counts(kb) if counts is None else counts
    totals = counts.groupBy("rel", "pos").agg(F.sum("n").alias("total"))
    # one row for each column of the catalogue is broadcast
    found = counts.join(F.broadcast(totals), ["rel", "pos"])
    bar = F.col("total") * F.lit(coverage)
    return found.filter(F.col("n") > F.floor(bar) if strict else F.col("n") >= F.ceil(bar)).select("rel", "pos", "val", "n")


def column_jaccard(kb: KnowledgeBase, counts: DataFrame | None = None) -> DataFrame:
    """``rel1, pos1, rel2, pos2, jaccard``: shared over united occurrences of values, for pairs of different columns in order.

    Pairs without a common value are left out; theirs is 0.  A value meets itself in each pair of
    columns that have it, so it adds no more rows than there are pairs in the catalogue.
    """
    counts = value_counts(kb) if counts is None else counts
    totals = counts.groupBy("rel", "pos").agg(F.sum("n").alias("all"))
    columns = F.sort_array(F.collect_list(F.struct("rel", "pos", "n")))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.filter("x", lambda b, j: j > i), lambda b: F.struct(F.struct(a["rel"], a["pos"]).alias("a"), F.struct(b["rel"], b["pos"]).alias("b"), F.least(a["n"], b["n"]).alias("n")))))
    # the columns of one value are one row, bounded by the catalogue
    common = counts.groupBy("val").agg(columns.alias("x")).filter(F.size("x") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("common"))
    t1 = totals.select(F.struct("rel", "pos").alias("a"), F.col("all").alias("t1"))
    t2 = totals.select(F.struct("rel", "pos").alias("b"), F.col("all").alias("t2"))
    out = common.join(F.broadcast(t1), "a").join(F.broadcast(t2), "b")  # one row for each column of the catalogue
    return out.select(F.col("a.rel").alias("rel1"), F.col("a.pos").alias("pos1"), F.col("b.rel").alias("rel2"), F.col("b.pos").alias("pos2"), (F.col("common") / (F.col("t1") + F.col("t2") - F.col("common"))).alias("jaccard"))


def similar_columns(kb: KnowledgeBase, least: float = 0.1, counts: DataFrame | None = None) -> DataFrame:
    return column_jaccard(kb, counts).filter(F.col("jaccard") >= least)


def statistics(kb: KnowledgeBase, constant_coverage: float = 0.25, similarity: float = 0.1) -> DataFrame:
    """One row: facts, functors, constants, constant substitutions (promising and all), column pairs (similar and all).

    All of it follows from the counts of values, which are written once.
    """
    n_columns = sum(kb.arities.values())
    pairs = n_columns * (n_columns - 1) // 2
    counts = cut_lineage(value_counts(kb))
    whole = counts.agg(F.coalesce(F.sum(F.when(F.col("pos") == 0, F.col("n"))), F.lit(0)).alias("facts"), F.count("*").alias("substitutions"))
    parts = [
        whole.select("facts", F.lit(len(kb.names)).cast("long").alias("functors"), "substitutions"),
        counts.select("val").distinct().agg(F.count("*").alias("constants")),
        promising_constants(kb, constant_coverage, True, counts).agg(F.count("*").alias("promising_substitutions")),
        similar_columns(kb, similarity, counts).agg(F.count("*").alias("similar_pairs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    names = ["facts", "functors", "constants", "promising_substitutions", "substitutions", "similar_pairs"]
    return out.select(*names, F.lit(pairs).cast("long").alias("column_pairs"))


def relation_similarity(kb: KnowledgeBase) -> DataFrame:
    """``rel1, rel2, similarity``: the largest similarity of their columns, for pairs of different relations."""
    j = column_jaccard(kb).filter("rel1 <> rel2")
    return j.groupBy(F.least("rel1", "rel2").alias("rel1"), F.greatest("rel1", "rel2").alias("rel2")).agg(F.max("jaccard").alias("similarity"))


def components_at(names: Iterable[str], pairs: Iterable[tuple[str, str, float]], bar: float) -> list[list[str]]:
    """Relations joined by a similarity of ``bar`` or more, the largest group first."""
    graph: dict[str, list[str]] = {n: [n] for n in names}
    for a, b, s in pairs:
        if s >= bar:
            graph[a].append(b)
            graph[b].append(a)
    return sorted((sorted(p) for p in tarjan(graph)), key=lambda p: (-len(p), p))


def connectivity(kb: KnowledgeBase, steps: int = 10) -> list[tuple[float, list[list[str]]]]:
    """Groups of relations for thresholds from 0 to 1."""
    pairs = [tuple(r) for r in relation_similarity(kb).collect()]  # pairs of the catalogue
    return [(i / steps, components_at(kb.names, pairs, i / steps)) for i in range(steps + 1)]


def pivot(found: list[tuple[float, list[list[str]]]]) -> int:
    """Where the number of groups first grows by less than it did one threshold before; the last threshold if it never does."""
    grown = [len(b) - len(a) for (_, a), (_, b) in zip(found, found[1:], strict=False)]
    return next((i for i, (before, now) in enumerate(zip([0, *grown], grown, strict=False)) if now < before), len(found) - 1)


def split(kb: KnowledgeBase, parts: int | None = None, steps: int = 10) -> list[list[str]]:
    """Groups of relations at the pivot, or at the first threshold that leaves ``parts`` groups at least; relations without a group are one each."""
    return _split(kb, connectivity(kb, steps), parts)


def _split(kb: KnowledgeBase, found: list[tuple[float, list[list[str]]]], parts: int | None) -> list[list[str]]:
    groups = found[pivot(found)][1] if parts is None else next((g for _, g in found if len(g) >= parts), [])
    return groups + [[n] for n in kb.names if n not in {x for g in groups for x in g}]


def write_split(kb: KnowledgeBase, parts: int | None, path: str, steps: int = 10) -> list[list[str]]:
    """The groups of :func:`split`, each written below ``path``, and the groups of every threshold as JSON.

    Facts are lines of text; of relations that are kept by groups, the groups and links are Parquet beside them (``split-<i>-groups``, ``split-<i>-links``),
    which ``grouped`` lists.  :func:`read_split` reads either.
    """
    found = connectivity(kb, steps)
    groups = _split(kb, found, parts)
    held = [[n for n in names if n in kb.grouped] for names in groups]
    for i, names in enumerate(groups):
        plain = [n for n in names if n not in held[i]]
        rows = kb.facts(plain).select(F.concat_ws("\t", F.array("rel"), F.col("args")).alias("value")) if plain else kb.spark.createDataFrame([], "value string")
        rows.write.mode("overwrite").text(f"{path}/split-{i}")
        if held[i]:
            of = {n: kb.groups_of(n) for n in held[i]}
            union(g.groups.select(F.lit(n).alias("rel"), "val", "grp") for n, g in of.items()).write.mode("overwrite").parquet(f"{path}/split-{i}-groups")
            union(g.links.select(F.lit(n).alias("rel"), "s", "t", "off", "diag") for n, g in of.items()).write.mode("overwrite").parquet(f"{path}/split-{i}-links")
    for name, lines in (("grouped", held), ("connectivity", [{"threshold": bar, "groups": g} for bar, g in found])):
        kb.spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return groups


def read_split(spark: SparkSession, path: str, part: int) -> tuple[DataFrame, dict[str, Grouped]]:
    """One part of a split: ``rel`` and ``args`` of its lines, and its relations that are kept by groups."""
    from ..sources.facts import read_fact_lines

    # one line for each part
    held = json.loads([r["value"] for r in spark.read.text(f"{path}/grouped").collect()][part])
    table = lambda kind, n: spark.read.parquet(f"{path}/split-{part}-{kind}").filter(F.col("rel") == n).drop("rel")
    return read_fact_lines(spark, f"{path}/split-{part}"), {n: Grouped(table("groups", n), table("links", n)) for n in held}


def split_sizes(spark: SparkSession, path: str, part: int) -> DataFrame:
    """``rel, facts`` of one part of a split, from its files; relations without facts have no row."""
    lines, held = read_split(spark, path, part)
    return union([lines.groupBy("rel").agg(F.count("*").alias("facts")), *(g.count().filter("n > 0").select(F.lit(n).alias("rel"), F.col("n").alias("facts")) for n, g in held.items())])
