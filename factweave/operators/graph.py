"""Strongly connected components and feedback vertex sets of an edge table ``src, dst``.

A graph of at most ``CORE_EDGES`` edges is counted and taken to the driver, where Tarjan's algorithm runs.
A larger one is reduced in Spark until it is that small, or until no reduction helps:

* nodes without a way in or out cannot be on a cycle and are trimmed;
* nodes with one way in and one way out are *passed*: a chain of them becomes one edge between
  its ends.  The nodes of a chain find its ends by doubling their pointers, so a chain of n nodes takes log n rounds, and a path
  that trimming would eat from its ends goes at once.  A chain that closes is a component of its own.

What cannot be reduced is split by colouring.  Nodes that were passed are in the component of their chain's ends
where these are in one component, and in none otherwise.

Feedback vertex sets are chosen greedily within each component, in one task while it is small.
Large ones are cut in rounds: of the nodes whose product of ways in and out is near the largest, those go that none
of their neighbours exceeds, then the rest is trimmed and chains are passed again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import done_with
from .kb import cut_lineage, union

CORE_EDGES = 500_000
#: A round of a large feedback set takes nodes of at least this share of the largest product of ways.
NEAR = 0.5


def _trimmed_once(now: DataFrame) -> DataFrame:
    return now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


@dataclass
class Chains:
    """What passing chains gave: the edges that are left, the passed nodes with the ends of their chains, and closed chains."""

    edges: DataFrame
    inner: DataFrame | None = None  # node, src, dst
    rings: DataFrame | None = None  # node, component


def chains_passed(edges: DataFrame) -> Chains:
    """Chains of nodes with one way in and one way out, each replaced by an edge.

    A passed node points at the one before it, then twice as far with each round, until a node is reached that stays.
    """
    ways = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("string").alias("before"), F.col("dst").alias("after"))
    ways = ways.unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("before"), F.lit(None).cast("string").alias("after")))
    single = ways.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("before").alias("before"), F.min("after").alias("after"))
    single = cut_lineage(single.filter("i = 1 AND o = 1 AND before <> node").select("node", "before", "after"))
    n = single.count()
    if not n:
        done_with(single)
        return Chains(edges)
    passed = single.select(F.col("node").alias("before"), F.lit(True).alias("goes_on"))
    # at: the node reached; start: what stands before it, once that is a node that stays; least: the least node on the way
    start = F.when(F.col("goes_on").isNull(), F.col("before"))
    at = F.when(F.col("goes_on").isNull(), F.col("node")).otherwise(F.col("before"))
    now = cut_lineage(single.join(passed, "before", "left").select("node", at.alias("at"), start.alias("start"), F.least("node", at).alias("least"), F.lit(True).alias("moved")))
    open_before, none = n + 1, F.lit(None).cast("boolean")
    for _ in range(n.bit_length() + 1):
        found = now.filter("start IS NULL").agg(F.count("*").alias("n"), F.bool_or("moved").alias("moved")).first()
        # a round closes some node of each open chain; where it closed none only rings are open, and these are known once no least node moves
        if not found["n"] or (found["n"] == open_before and not found["moved"]):
            break
        open_before = found["n"]
        far = now.select(F.col("node").alias("at"), F.col("at").alias("far_at"), F.col("start").alias("far_start"), F.col("least").alias("far_least"))
        open_ = now.filter("start IS NULL").join(far, "at").select("node", F.col("far_at").alias("at"), F.col("far_start").alias("start"), F.least("least", "far_least").alias("least"), (F.col("far_least") < F.col("least")).alias("moved"))
        ended = now.filter("start IS NOT NULL").select("node", "at", "start", "least", none.alias("moved"))
        before, now = now, cut_lineage(ended.unionByName(open_))
        done_with(before)
    rings = now.filter("start IS NULL").select("node", F.col("least").alias("component"))
    ended = now.filter("start IS NOT NULL").select("node", "at", F.col("start").alias("src"))
    last = single.join(single.select(F.col("node").alias("after")), "after", "left_anti").select("node", F.col("after").alias("dst"))
    chain = ended.join(last, "node").select("at", "src", "dst")  # one row for each chain
    inner = cut_lineage(ended.select("node", "at").join(chain, "at").select("node", "src", "dst"))
    stay = edges.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(single.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    left = cut_lineage(stay.unionByName(inner.select("src", "dst")).distinct())
    done_with(single)
    return Chains(left, inner, rings)


@dataclass
class Reduced:
    """A graph without nodes that are on no cycle for certain, and the chains that were passed, in order."""

    edges: DataFrame
    count: int
    passed: list[Chains] = field(default_factory=list)
    rounds: int = 0

    def rings(self) -> list[DataFrame]:
        return [c.rings for c in self.passed if c.rings is not None]


def reduced(edges: DataFrame, enough: int = 0) -> Reduced:
    """Trims and passes chains until neither changes anything, or at most ``enough`` edges are left."""
    out = Reduced(cut_lineage(edges.select("src", "dst").distinct()), 0)
    out.count = out.edges.count()
    while out.count > enough:
        out.rounds += 1
        cut = cut_lineage(_trimmed_once(out.edges))
        found = chains_passed(cut)
        left = found.edges.count()
        done_with(out.edges)
        if found.edges is not cut:
            out.passed.append(found)
            done_with(cut)
        same, out.edges, out.count = left == out.count, found.edges, left
        if same:
            break
    return out


def tarjan(graph: dict[str, Iterable[str]]) -> list[set[str]]:
    """Components with a cycle, without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    out: list[set[str]] = []
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(graph.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    on.add(m)
                    work.append((m, iter(graph.get(m, ()))))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    part: set[str] = set()
                    while n not in part:
                        part.add(m := stack.pop())
                        on.discard(m)
                    if len(part) > 1 or n in set(graph.get(n, ())):
                        out.append(part)
    return out


def feedback_vertices(graph: dict[str, set[str]]) -> list[str]:
    """Greedy: the node with the largest product of ways in and out goes, then all that is no longer on a cycle."""
    ways_out = {n: set(m) for n, m in graph.items()}
    for m in {m for ms in graph.values() for m in ms}:
        ways_out.setdefault(m, set())
    ways_in: dict[str, set[str]] = {n: set() for n in ways_out}
    for n, ms in ways_out.items():
        for m in ms:
            ways_in[m].add(n)
    chosen: list[str] = []

    def drop(n: str) -> list[str]:
        near = [*ways_out[n], *ways_in[n]]
        for m in ways_out.pop(n):
            ways_in[m].discard(n)
        for m in ways_in.pop(n):
            if m in ways_out:
                ways_out[m].discard(n)
        return [m for m in near if m in ways_out]

    def strip(nodes: Iterable[str]) -> None:
        waiting = list(nodes)
        while waiting:
            n = waiting.pop()
            if n in ways_out and (not ways_out[n] or not ways_in[n]):
                waiting += drop(n)

    strip(list(ways_out))
    while ways_out:
        best = min(ways_out, key=lambda n: (-len(ways_in[n]) * len(ways_out[n]), n))
        chosen.append(best)
        strip(drop(best))
    return chosen


def _edges_here(edges: DataFrame) -> dict[str, list[str]]:
    """The graph, where its size was checked."""
    graph: dict[str, list[str]] = {}
    table = edges.select("src", "dst").toArrow()
    for src, dst in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        graph.setdefault(src, []).append(dst)
    return graph


def components(edges: DataFrame, core_edges: int = CORE_EDGES) -> DataFrame:
    """``node, component`` for all nodes on cycles; a component is named by its least node."""
    spark, core = edges.sparkSession, reduced(edges, core_edges)
    if core.count <= core_edges:
        rows = [(n, min(part)) for part in tarjan(_edges_here(core.edges)) for n in part]
        found = spark.createDataFrame(rows, "node string, component string")
    else:
        found = _coloured(core.edges)
    if not core.passed:
        return found
    for chains in reversed(core.passed):
        ends = [found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("src", "dst")]
        inside = chains.inner.join(ends[0], "src").join(ends[1], "dst").filter("of_src = of_dst").select("node", F.col("of_src").alias("component"))
        found = cut_lineage(found.unionByName(inside))
    found = union([found, *core.rings()])
    # passed nodes may be less than those that were named
    names = found.groupBy("component").agg(F.min("node").alias("name"))
    return cut_lineage(found.join(names, "component").select("node", F.col("name").alias("component")))


def _spread(start: DataFrame, steps: DataFrame) -> DataFrame:
    """The least colour that reaches each node along ``steps`` (``a`` to ``b``)."""
    now = cut_lineage(start)
    while True:
        arrived = now.join(steps.withColumnRenamed("a", "node"), "node").select(F.col("b").alias("node"), "colour")
        after = cut_lineage(now.unionByName(arrived).groupBy("node").agg(F.min("colour").alias("colour")))
        changed = after.join(now, ["node", "colour"], "left_anti").limit(1).count()
        done_with(now)
        now = after
        if not changed:
            return now


def _coloured(core: DataFrame) -> DataFrame:
    """Components by colouring: the least node that reaches a node is its colour; those that reach it back are its component."""
    spark, out = core.sparkSession, None
    while core.limit(1).count():
        nodes = core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")), core.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        both = core.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("x")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("y")), "dst").filter("x = y")
        back = _spread(colour.filter("node = colour"), both.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        found = back.select("node", F.col("colour").alias("component"))
        sized = found.join(found.groupBy("component").agg(F.count("*").alias("n")), "component")
        loops = core.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
        cyclic = sized.join(loops, "node", "left").filter("n > 1 OR loop").select("node", "component")
        out = cut_lineage(cyclic if out is None else out.unionByName(cyclic))
        done = back.select("node")
        left = core.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        core = cut_lineage(_trimmed_once(left))
    return spark.createDataFrame([], "node string, component string") if out is None else out


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feedback vertices of components that follow one another; there may be very many small ones."""

    def chosen(name: str, graph: dict[str, set[str]]) -> list[tuple[str, str]]:
        return [(n, name) for n in feedback_vertices(graph)]

    name, graph = None, {}
    for batch in batches:
        out: list[tuple[str, str]] = []
        for component, src, dst in zip(*(batch.column(c).to_pylist() for c in ("component", "src", "dst")), strict=True):
            if component != name:
                out += chosen(name, graph)
                name, graph = component, {}
            graph.setdefault(src, set()).add(dst)
        yield _chosen(out)
    yield _chosen(chosen(name, graph))


def _chosen(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["node", "component"])


def feedback_set(edges: DataFrame, found: DataFrame | None = None, core_edges: int = CORE_EDGES) -> DataFrame:
    """``node, component``: facts whose removal leaves no cycle.

    Components of at most ``core_edges`` edges are one task each; larger ones are cut in rounds of many tasks.
    """
    found = components(edges, core_edges) if found is None else found
    inside = edges.join(found.select(F.col("node").alias("src"), "component"), "src").join(found.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").filter("component = other").select("component", "src", "dst").distinct()
    inside = cut_lineage(inside)
    large = [r["component"] for r in inside.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > core_edges).collect()]  # few: each has that many edges
    small = inside.filter(~F.col("component").isin(large)) if large else inside
    out = [small.repartition("component").sortWithinPartitions("component").mapInArrow(_greedy, "node string, component string")]
    for name in large:
        one = inside.filter(F.col("component") == name).select("src", "dst")
        out.append(_in_rounds(one, core_edges).select("node", F.lit(name).alias("component")))
    return union(out)


def _in_rounds(edges: DataFrame, core_edges: int) -> DataFrame:
    """``node``: a feedback set of one large component."""
    spark, chosen = edges.sparkSession, []
    now = reduced(edges, core_edges)
    while True:
        # of a closed chain any node will do
        chosen += [r.filter("node = component").select("node") for r in now.rings()]
        if now.count <= core_edges:
            rest = feedback_vertices({n: set(m) for n, m in _edges_here(now.edges).items()})
            break
        picked = cut_lineage(_peaks(now.edges))
        chosen.append(picked)
        left = now.edges.join(picked.withColumnRenamed("node", "src"), "src", "left_anti").join(picked.withColumnRenamed("node", "dst"), "dst", "left_anti")
        now = reduced(left.select("src", "dst"), core_edges)
    return union([*chosen, spark.createDataFrame([(n,) for n in rest], "node string")]).distinct()


def _peaks(edges: DataFrame) -> DataFrame:
    """``node``: nodes with an edge to themselves; and those near the largest product of ways in and out that no neighbour exceeds, ties by hash."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    both = edges.filter("src <> dst")
    ways = both.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(both.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    rank = F.struct((F.sum("i") * F.sum("o")).alias("ways"), F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    ranks = cut_lineage(ways.groupBy("node").agg(rank.alias("rank")))
    bar = ranks.agg(F.max("rank.ways")).first()[0]
    if bar is None:
        return loops
    able = ranks.filter(F.col("rank.ways") >= NEAR * bar)
    near = both.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(both.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    beaten = able.join(near, "node").join(able.select(F.col("node").alias("other"), F.col("rank").alias("their")), "other").filter("their > rank").select("node")
    return able.join(beaten, "node", "left_anti").select("node").unionByName(loops).distinct()


def acyclic(edges: DataFrame) -> bool:
    left = reduced(edges)
    return left.count == 0 and not any(r.take(1) for r in left.rings())
