"""Golden scores of rules on small knowledge bases."""

import pytest

from factweave.operators.evaluate import coverage, evaluate, scored
from factweave.operators.kb import KnowledgeBase

# FAMILY, GOLDEN and OTHER are fixed values: scores that any engine for such rules must give.
FAMILY = {
    "father": ["f1 s1", "f2 s2", "f2 d2", "f3 s3", "f4 d4"],
    "parent": ["f1 s1", "f1 d1", "f2 s2", "f2 d2", "m2 d2", "g1 f1", "g2 f2", "g2 m2", "g3 f3"],
    "grandParent": ["g1 s1", "g2 d2", "g4 s4"],
}


def kb_of(spark, relations):
    kb = KnowledgeBase(spark)
    for name, rows in relations.items():
        kb.attach_rows(name, [r.split() for r in rows])
    return kb


GOLDEN = [
    ("parent(?,?):-", 9, 256, 0),
    ("parent(X,?):-father(X,?)", 4, 64, 1),
    ("parent(?,X):-father(?,X)", 4, 80, 1),
    ("grandParent(X,?):-parent(X,?)", 2, 96, 1),
    ("grandParent(X,Y):-parent(X,?),parent(?,Y)", 2, 48, 2),
    ("grandParent(X,?):-parent(X,Y),parent(Y,?)", 2, 32, 2),
    ("grandParent(X,Z):-parent(X,Y),parent(Y,Z)", 2, 4, 3),
    ("grandParent(X,?):-parent(X,Y),father(Y,?)", 2, 48, 2),
    ("grandParent(X,Z):-parent(X,Y),father(Y,Z)", 2, 4, 3),
    ("grandParent(?,X):-father(?,X)", 2, 80, 1),
    ("grandParent(g1,X):-father(?,X)", 1, 5, 2),
    ("parent(X,X):-", 0, 16, 1),
    ("father(?,?):-", 5, 256, 0),
    ("father(X,?):-parent(?,X)", 4, 128, 1),
    ("father(X,?):-parent(?,X),parent(X,?)", 3, 48, 2),
    ("father(f2,?):-", 2, 16, 1),
]


def test_family(spark):
    rows = {r["rule"]: r for r in scored(kb_of(spark, FAMILY), [g[0] for g in GOLDEN]).collect()}
    from factweave.plans.rule import parse_rule

    for text, pos, total, length in GOLDEN:
        r = rows[str(parse_rule(text))]
        assert (r["pos"], r["all"], r["length"]) == (pos, total, length), text


OTHER = [
    ({"p": ["a A +", "b B +", "c C -"], "h": ["a a A A", "b b B B"]}, "h(X,X,Y,Y):-p(X,Y,'+')", 2, 2, 5),
    ({"p": ["A a", "a a", "b a"], "q": ["b", "a"], "h": ["a"]}, "h(X):-p(X,X),q(X)", 1, 1, 3),
    ({"h": ["a a", "b b", "a c"]}, "h(X,X):-", 2, 3, 1),
    ({"h": ["a a b", "b b a", "a b b"]}, "h(X,X,?):-", 2, 4, 1),
]


@pytest.mark.parametrize(("relations", "rule", "pos", "total", "length"), OTHER)
def test_structures(spark, relations, rule, pos, total, length):
    e = evaluate(kb_of(spark, relations), rule)
    assert (e.pos, e.all, e.length) == (pos, total, length)


def test_entailed_facts_do_not_count_again(spark):
    kb = kb_of(spark, FAMILY)
    kb.entail("father", [("f2", "s2"), ("f2", "d2")])
    e = evaluate(kb, "father(?,?):-")
    assert (e.pos, e.all) == (3, 254)
    kb.entail("parent", [r.split() for r in FAMILY["parent"][:4]])
    e = evaluate(kb, "parent(X,Y):-father(X,Y)")
    assert (e.pos, e.all, e.length) == (1, 3, 2) or e.pos == 0
    assert coverage(kb, ["father(?,?):-"]).first()["coverage"] == pytest.approx(3 / 5)
