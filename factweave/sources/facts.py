"""Facts in tab-separated text: ``relation<TAB>argument<TAB>argument ..``, one on a line.

A relation that is kept by groups may be written as such: ``relation@groups<TAB>value<TAB>group`` and
``relation@links<TAB>group<TAB>group<TAB>off<TAB>diag`` (see :class:`operators.grouped.Grouped`), a line for each value and link
instead of one for each pair.  Such lines are facts like any other to whoever gathers them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouped import Grouped
from ..operators.kb import KnowledgeBase, columns, union
from .shared import scratch

GROUPS, LINKS = "@groups", "@links"


def read_fact_lines(spark: SparkSession, path: str) -> DataFrame:
    """``rel`` and ``args``; empty lines are left out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parts[0].alias("rel"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("args"))


def read_facts(spark: SparkSession, path: str, name: str = "kb") -> KnowledgeBase:
    """A knowledge base from fact lines.  Lines of one relation that differ in arity are an error.

    The text is read once: its different facts are written by relation, and a relation reads its own folder.
    """
    held = scratch(spark, "facts")
    read_fact_lines(spark, path).distinct().withColumn("folder", F.col("rel")).write.partitionBy("folder").parquet(held)
    table = spark.read.schema("rel string, args array<string>, folder string").parquet(held)
    # one row for each relation of the catalogue
    found = table.groupBy("rel").agg(F.min(F.size("args")).alias("least"), F.max(F.size("args")).alias("most")).collect()
    kb = KnowledgeBase(spark, name)
    of = lambda rel: table.filter(F.col("folder") == rel)
    arities = {}
    for r in sorted(found, key=lambda r: r["rel"]):
        if r["least"] != r["most"] or r["least"] < 1:
            raise ValueError(f"facts of {r['rel']} have {r['least']} to {r['most']} arguments")
        arities[r["rel"]] = r["most"]
    plain, by_groups = kinds(arities)
    for rel in sorted({*plain, *by_groups}):
        own = of(rel).select(*(F.col("args")[i].alias(c) for i, c in enumerate(columns(arities[rel])))) if rel in plain else None
        if rel not in by_groups:
            kb.attach(rel, own, known_set=True)
            continue
        groups = groups_of(of(rel + GROUPS), of(rel + LINKS)).written()
        if own is None:
            kb.attach_grouped(rel, groups)
        else:
            kb.attach(rel, beside(own, groups).unionByName(groups.pairs()), known_set=True)
    return kb


def kinds(names: Iterable[str]) -> tuple[list[str], list[str]]:
    """Of names as they stand in lines, the relations with facts and those with groups."""
    names = sorted(names)
    return [n for n in names if not n.endswith((GROUPS, LINKS))], [n.removesuffix(GROUPS) for n in names if n.endswith(GROUPS)]


def groups_of(groups: DataFrame, links: DataFrame) -> Grouped:
    """A relation from the ``args`` of its lines of groups and links, which may have come at different times.

    A value that was named in several groups has the links of each.
    """
    at = lambda i: F.col("args")[i]
    linked = links.select(at(0).alias("s"), at(1).alias("t"), (at(2) == "true").alias("off"), (at(3) == "true").alias("diag"))
    return Grouped.regrouped(groups.select(at(0).alias("val"), at(1).alias("grp")), linked)


def beside(pairs: DataFrame, groups: Grouped) -> DataFrame:
    """Those of the pairs (``c0, c1``) that do not follow from the groups."""
    return pairs.join(groups.holding(pairs, "c0", "c1"), columns(2), "left_anti")


def fact_lines(kb: KnowledgeBase, by_groups: bool = False) -> DataFrame:
    """A line for each fact; with ``by_groups`` one for each value and link of relations that are kept by groups."""
    held = [n for n in kb.names if by_groups and n in kb.grouped]
    plain = [n for n in kb.names if n not in held]
    parts = [kb.facts(plain).select(F.concat_ws("\t", F.array("rel"), F.col("args")).alias("value"))] if plain else []
    for n in held:
        g = kb.groups_of(n)
        parts.append(g.groups.select(F.concat_ws("\t", F.lit(n + GROUPS), "val", "grp").alias("value")))
        parts.append(g.links.select(F.concat_ws("\t", F.lit(n + LINKS), "s", "t", F.col("off").cast("string"), F.col("diag").cast("string")).alias("value")))
    return union(parts)


def write_facts(kb: KnowledgeBase, path: str, by_groups: bool = False) -> None:
    fact_lines(kb, by_groups).write.text(path)


def write_result(result, path: str) -> None:
    """A compressed knowledge base as text: rules, then fact lines of the necessary part and of the counterexamples, and symbols."""
    spark = result.necessary.spark
    spark.createDataFrame([(str(r),) for r in result.rules], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rules")
    write_facts(result.necessary, f"{path}/necessary")
    wrong = KnowledgeBase(spark, "counterexamples")
    for name, df in result.counterexamples.items():
        wrong.attach(name, df, known_set=True)
    if wrong.names:
        write_facts(wrong, f"{path}/counterexamples")
    result.supplementary.select(F.col("val").alias("value")).write.text(f"{path}/supplementary")
