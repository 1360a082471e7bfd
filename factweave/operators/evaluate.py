"""Scores of rules, one by one or many in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..plans.compile import RulePlan, power
from ..plans.rule import Rule, parse_rule
from .kb import KnowledgeBase, union


def as_rule(rule: Rule | str) -> Rule:
    return parse_rule(rule) if isinstance(rule, str) else rule


def scored(kb: KnowledgeBase, rules: list[Rule | str], symbols: DataFrame | None = None) -> DataFrame:
    """``rule, pos, all, length, tau, delta, h`` for each rule, as one plan.

    ``pos`` counts facts not entailed before, ``all`` leaves out those entailed before.
    """
    size = (kb.constants() if symbols is None else symbols).agg(F.count("*").cast("double").alias("_symbols"))
    rows = []
    for r in map(as_rule, rules):
        plan = RulePlan(kb, r)
        rows.append(plan.counts().select(F.lit(str(r)).alias("rule"), F.col("new").cast("double").alias("pos"), "old", "bodies", F.lit(float(plan.free)).alias("_free"), F.lit(float(r.length)).alias("length")))
    out = union(rows).crossJoin(F.broadcast(size))  # a single row
    out = out.withColumn("all", F.col("bodies") * F.pow("_symbols", "_free") - F.col("old"))
    pos, total, length = F.col("pos"), F.col("all"), F.col("length")
    return out.select("rule", "pos", "all", "length", scores.tau(pos, total, length).alias("tau"), scores.delta(pos, total, length).alias("delta"), scores.first_gain(pos, total).alias("h"))


def evaluate(kb: KnowledgeBase, rule: Rule | str, symbols: int | None = None) -> scores.Eval:
    """The Eval of one rule."""
    r = as_rule(rule)
    plan = RulePlan(kb, r)
    row = plan.counts().first()
    n = kb.constants().count() if symbols is None else symbols
    return scores.evaluation(float(row["new"]), row["bodies"] * power(n, plan.free) - row["old"], r.length)


def coverage(kb: KnowledgeBase, rules: list[Rule | str]) -> DataFrame:
    """``rule, covered, total, coverage``: the share of a relation that a rule newly entails."""
    rows = []
    for r in map(as_rule, rules):
        head = r.head.relation
        new = RulePlan(kb, r).covered()
        rows.append(new.crossJoin(kb.size(head).withColumnRenamed("n", "total")).select(F.lit(str(r)).alias("rule"), "covered", "total"))
    return union(rows).withColumn("coverage", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("covered") / F.col("total")))
