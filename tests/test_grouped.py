"""Relations between groups of symbols, compared with their pairs."""

import itertools

import pytest
from pyspark.sql import functions as F

from factweave.operators import candidates as cand
from factweave.operators import graph
from factweave.operators import profile
from factweave.operators.evaluate import coverage, scored
from factweave.operators.compress import compress_with
from factweave.operators.evidence import dependencies, dependency_edges
from factweave.operators.grouped import BLOCK, Grouped
from factweave.operators.kb import KnowledgeBase
from factweave.plans.compile import RulePlan
from factweave.plans.rule import parse_rule
from factweave.queries import QUERIES
from factweave.sources import store
from factweave.sources.shared import written

MEMBERS = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "1"), ("d", "2"), ("e", "3"), ("f", "4"), ("g", "4"), (None, "1"), ("h", None), ("a", "1")]
OTHER = [("a", "x"), ("b", "x"), ("e", "x"), ("f", "y"), ("g", "y"), ("k", "y"), ("c", "z")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain(members, loops):
    held = {m for m in members if None not in m}
    return sorted({(a, b) for (a, x), (b, y) in itertools.product(held, held) if x == y and (loops or a != b)})


def test_views_follow_from_groups(spark):
    for loops in (False, True):
        want = plain(MEMBERS, loops)
        one, other = KnowledgeBase(spark), KnowledgeBase(spark)
        one.attach_mates("mates", spark.createDataFrame(MEMBERS, "v string, k string"), loops)
        other.attach("mates", spark.createDataFrame(want, "a string, b string"))
        for kb in (one, other):
            kb.attach_rows("p", [("a", "b"), ("z", "a")])
        assert rows(one["mates"]) == want and rows(one.size("mates")) == [(len(want),)]
        for view in (KnowledgeBase.facts, KnowledgeBase.cells, KnowledgeBase.domains, KnowledgeBase.constants, KnowledgeBase.value_counts, profile.sizes, profile.column_jaccard, profile.statistics):
            assert rows(view(one)) == rows(view(other)), view
        # neither the domains nor the counts read pairs
        for view in (KnowledgeBase.domains, KnowledgeBase.constants, KnowledgeBase.value_counts):
            assert '"block"' not in (plan := view(one)._jdf.queryExecution().optimizedPlan().toString()) and "collect_list" not in plan
        one.remove("mates", [want[0]])
        assert rows(one["mates"]) == want[1:] and ("mates", 0, want[0][0]) in rows(one.domains()) and rows(one.size("mates")) == [(len(want) - 1,)]


def test_pairs_come_by_blocks_of_all_tasks(spark):
    n = 3 * BLOCK
    got = Grouped.mates(spark.range(n).select(F.col("id").cast("string").alias("val"), F.lit("1").alias("cls"))).pairs()
    assert got.count() == got.distinct().count() == n * (n - 1)
    per = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) > 1 and max(r["count"] for r in per) < 0.9 * n * (n - 1)


def test_relations_meet_by_groups(spark):
    frame = lambda x: spark.createDataFrame(x, "val string, cls string")
    for one_loops, other_loops in ((False, True), (True, False)):
        one, other = Grouped.mates(frame(MEMBERS), one_loops), Grouped.mates(frame(OTHER), other_loops)
        a, b = set(plain(MEMBERS, one_loops)), set(plain(OTHER, other_loops))
        assert rows(one.met(other).pairs()) == sorted(a & b) and one.met(other).count().first()[0] == len(a & b)
        for (x, p), (y, q) in itertools.product(((one, a), (other, b)), repeat=2):
            assert rows(x.then(y).pairs()) == sorted({(i, l) for i, j in p for k, l in q if j == k})
        some = spark.createDataFrame([(x,) for x in "abf"], "val string")
        assert rows(one.restricted(some, None).pairs()) == sorted(p for p in a if p[0] in "abf")
        assert rows(one.restricted(some, some).pairs()) == sorted(p for p in a if p[0] in "abf" and p[1] in "abf")
        asked = spark.createDataFrame(list(itertools.product("abcefk", repeat=2)), "x string, y string")
        assert rows(one.holding(asked, "x", "y")) == sorted(p for p in itertools.product("abcefk", repeat=2) if p in a)
        further = [("a", "u"), ("b", "u"), ("c", "v"), ("e", "w"), ("f", "t"), ("k", "s")]
        assert rows(one.hop(spark.createDataFrame(further, "z string, y string"), "z", "x")) == sorted({(i, y) for i, j in a for z, y in further if j == z})
        assert rows(one.loops()) == sorted((x,) for x, y in a if x == y)


def both(spark):
    one, other = KnowledgeBase(spark), KnowledgeBase(spark)
    one.attach_mates("mates", spark.createDataFrame(MEMBERS, "v string, k string"))
    other.attach("mates", spark.createDataFrame(plain(MEMBERS, False), "a string, b string"))
    for kb in (one, other):
        kb.attach_rows("at", [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("f", "4"), ("x", "4")])
        kb.attach_rows("near", [("a", "b"), ("f", "g"), ("g", "f"), ("a", "x"), ("b", "b")])
    return one, other


def test_rules_are_counted_by_groups(spark):
    one, other = both(spark)
    rules = ["mates(X,Y):-mates(Y,X)", "mates(X,Y):-at(X,Z),at(Y,Z)", "mates(X,Y):-mates(X,Z),mates(Z,Y)", "mates(X,Y):-near(X,Y)", "mates(X,Y):-near(Y,?),near(X,?)", "mates(X,X):-at(X,?)", "at(X,Y):-mates(X,Z),at(Z,Y)", "mates(?,?):-near(?,nobody)"]
    found = lambda kb: rows(scored(kb, rules).select("rule", "pos", "all"))
    assert found(one) == found(other)
    assert rows(coverage(one, rules)) == rows(coverage(other, rules))
    plans = [RulePlan(one, parse_rule(r)).counts()._jdf.queryExecution().optimizedPlan().toString() for r in rules[:5]]
    assert not any("collect_list" in p for p in plans)
    one.entail_where("mates", "c0 < c1")
    other.entail("mates", other["mates"].filter("c0 < c1"))
    assert rows(one.entailed["mates"]) == rows(other.entailed["mates"]) and found(one) == found(other)


def test_edges_and_refinements_by_groups(spark):
    one, other = both(spark)
    rules = ["mates(X,Y):-mates(Y,X)", "at(X,Y):-near(X,?),at(X,Y)", "mates(X,Y):-near(X,Y)"]
    edges = [rows(dependency_edges(kb, rules)) for kb in both(spark)]
    assert edges[0] == edges[1] and len(edges[0]) == len(set(edges[0]))
    for parent in ("mates(X,?):-mates(?,X)", "mates(X,?):-at(X,?)"):
        rule = parse_rule(parent)
        few = [c for c in cand.admitted(cand.specialisations(rule, one.arities, {}), cand.Seen())][: cand.FEW]
        counts = []
        for kb in (one, other):
            domains = kb.domains()
            counts.append(cand.Level(kb, domains, cand.domain_sizes(domains), kb.constants().count()).count([(rule, few)]))
        assert counts[0] == counts[1]


def test_a_mirrored_relation_is_compressed_and_recovered_by_groups(spark, tmp_path):
    """Neither the choice of a feedback set nor the recovery makes pairs; both give what they give without groups."""
    rules = ["mates(X,Y):-mates(Y,X)", "mates(X,Y):-at(X,Z),at(Y,Z)", "at(X,Y):-near(X,?),at(X,Y)"]
    results = [compress_with(kb, rules[:2]) for kb in both(spark)]
    one, other = results
    assert one.mirrors and not other.mirrors and "mates" in one.necessary.halved
    for part in ("edges", "feedback"):
        assert rows(getattr(one, part)) == rows(getattr(other, part))
    assert rows(one.necessary.facts()) == rows(other.necessary.facts()) and rows(one.necessary.constants()) == rows(other.necessary.constants())
    assert {n: rows(df) for n, df in one.counterexamples.items()} == {n: rows(df) for n, df in other.counterexamples.items()}
    assert one.sizes() == other.sizes()
    assert one.valid() and "mates" in one.recover().grouped
    store.write_bundle(one, str(tmp_path / "bundle"))
    back = store.read_bundle(spark, str(tmp_path / "bundle"))
    assert rows(back.recover().facts()) == rows(one.original.facts()) and rows(back.feedback) == rows(one.feedback)
    graphs = [dependencies(kb, rules[:2]) for kb in both(spark)]
    assert rows(graphs[0].components()) == rows(graphs[1].components()) and rows(graphs[0].nodes()) == rows(graphs[1].nodes())


def test_a_counterexample_among_mirrored_facts_stays_out(spark):
    result = compress_with(both(spark)[0], ["mates(X,Y):-mates(Y,X)"])
    gone = sorted(set(rows(result.original["mates"])) - set(rows(result.necessary["mates"])))[0]
    result.add_counterexamples("mates", [gone])
    assert gone not in rows(result.recover()["mates"])


def test_rings_end_the_doubling_of_pointers(spark, monkeypatch):
    """Rings of two nodes are known after one round, whatever their number."""
    edges = [(f"{a}{i}", f"{b}{i}") for i in range(300) for a, b in ("xy", "yx")] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    made = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or written(df))
    found = rows(graph.components(spark.createDataFrame(edges, "src string, dst string"), core_edges=0))
    assert found == sorted([(f"{a}{i}", f"x{i}") for i in range(300) for a in "xy"] + [(f"r{i}", "r0") for i in range(7)])
    assert len(made) < 14


def test_refinements_are_counted_from_one_table_of_domains(spark, monkeypatch):
    """The tables are read once for the domains, and not again for the symbols."""
    monkeypatch.setattr(KnowledgeBase, "constants", lambda self: pytest.fail("the symbols are in the domains"))
    assert QUERIES["candidates_case5"](spark, "/root/testdata/sf0.001").count()


def test_a_split_keeps_relations_by_groups(spark, tmp_path):
    """No line is written for a pair, and the files give all facts back."""
    results = []
    for kb, name in zip(both(spark), ("one", "other"), strict=True):
        path = str(tmp_path / name)
        groups = profile.write_split(kb, 2, path)
        sizes = [r for i in range(len(groups)) for r in rows(profile.split_sizes(spark, path, i))]
        found = [profile.read_split(spark, path, i) for i in range(len(groups))]
        pairs = sorted(tuple(r["args"]) for lines, _ in found for r in lines.filter("rel = 'mates'").collect())
        held = [g for _, groups_of in found for g in groups_of.values()]
        results.append((groups, sorted(sizes), pairs or rows(held[0].pairs())))
        assert bool(pairs) == (name == "other") and len(held) == (name == "one")
    assert results[0] == results[1]


def test_a_relation_without_pairs_has_no_row_in_a_split(spark, tmp_path):
    kb = KnowledgeBase(spark)
    kb.attach_mates("mates", spark.createDataFrame([("a", "1"), ("b", "2")], "v string, k string"))
    kb.attach_rows("p", [("a", "b")])
    groups = profile.write_split(kb, 1, str(tmp_path))
    assert [r for i in range(len(groups)) for r in rows(profile.split_sizes(spark, str(tmp_path), i))] == [("p", 1)]


def test_a_stream_takes_relations_by_groups(spark, tmp_path):
    """No line arrives for a pair; pairs that come singly beside groups, and groups that come again, add nothing twice."""
    from factweave.sources import facts
    from factweave.streaming.intake import arrived, fact_stream, intake

    kb = both(spark)[0]
    facts.write_facts(kb, str(tmp_path / "in"), by_groups=True)
    (tmp_path / "text").mkdir()
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "in")).collect())
    assert not any(x.startswith("mates\t") for x in lines) and any(x.startswith("mates@groups\t") for x in lines)
    want = sorted((r["rel"], *r["args"]) for r in kb.facts().collect())
    pair = next(x for x in want if x[0] == "mates")
    got = []
    for more in ([], ["\t".join(pair), "mates\tnew\ta", *lines]):
        (tmp_path / "in" / f"more-{len(more)}.txt").write_text("".join(f"{x}\n" for x in more))
        intake(fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got.append(sorted((r["rel"], *r["args"]) for r in arrived(spark, str(tmp_path / "out")).collect()))
    assert got == [want, sorted([*want, ("mates", "new", "a")])]
    assert sorted((r["rel"], *r["args"]) for r in facts.read_facts(spark, str(tmp_path / "in")).facts().collect()) == got[1]


def test_groups_that_come_at_different_times(spark):
    """A value that is named in two groups stands beside the values of both."""
    groups = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("a", "1")], "val string, grp string")
    links = spark.createDataFrame([("1", "1", True, False), ("2", "2", True, False), ("2", "2", False, True)], "s string, t string, off boolean, diag boolean")
    assert rows(Grouped.regrouped(groups, links).pairs()) == [("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")]


def test_binary_folders_keep_relations_by_groups(spark, tmp_path):
    """A whole relation and a half of one come back by groups, with the facts that a row for each pair gives."""
    from factweave.sources import legacy

    kb = both(spark)[0]
    result = compress_with(kb, ["mates(X,Y):-mates(Y,X)"])
    for by_groups in (False, True):
        whole, half = str(tmp_path / f"w{by_groups}"), str(tmp_path / f"h{by_groups}")
        legacy.write_folder(kb, whole, by_groups=by_groups)
        legacy.write_compressed(result, half, by_groups=by_groups)
        assert bool(list((tmp_path / f"h{by_groups}").glob("mates_2_*.rel"))) != by_groups
        back, kept = legacy.read_folder(spark, whole), legacy.read_compressed(spark, half, kb.arities)
        assert ("mates" in back.grouped) == ("mates" in kept.necessary.halved) == by_groups
        assert rows(back.facts()) == rows(kb.facts()) == rows(kept.recover().facts())
        assert rows(kept.necessary.facts()) == rows(result.necessary.facts())
