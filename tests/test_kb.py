"""Knowledge bases: catalogue, records, profiles, storage."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import datagen, profile
from factweave.operators.kb import MOST_CHANGES, KbError, KnowledgeBase, NameMap
from factweave.sources import binary, facts, legacy, store
from factweave.sources.versions import VersionedRelation
from factweave.streaming.intake import fact_stream, intake


def rows(df):
    return sorted(map(tuple, df.collect()))


def small(spark):
    kb = KnowledgeBase(spark)
    kb.attach_rows("p", [("a", "b"), ("a", "c"), ("a", "b"), ("d", "b")])
    kb.attach_rows("q", [("b",), ("e",)])
    return kb


def test_catalogue_and_records(spark):
    kb = small(spark)
    assert kb.names == ["p", "q"] and kb.arity("p") == 2 and kb.arity("none") == 0 and not kb.has("none")
    assert rows(kb["p"]) == [("a", "b"), ("a", "c"), ("d", "b")]
    kb.add("p", [("x", "y"), ("a", "b")])
    kb.remove("p", [("a", "c"), ("no", "no")])
    assert rows(kb["p"]) == [("a", "b"), ("d", "b"), ("x", "y")]
    assert rows(kb.contains("p", [("a", "b"), ("a", "c")])) == [("a", "b", True), ("a", "c", False)]
    kb.entail("p", [("a", "b"), ("not", "there")])
    assert rows(kb.entailed["p"]) == [("a", "b")] and rows(kb.not_entailed("p")) == [("d", "b"), ("x", "y")]
    kb.remove("p", [("a", "b")])
    assert rows(kb.entailed["p"]) == []
    kb.create("r", 1)
    assert kb["r"].count() == 0
    for wrong in (lambda: kb.create("r", 2), lambda: kb["none"], lambda: kb.add("p", [("a",)]), lambda: kb.attach_rows("p", [("a",)])):
        with pytest.raises(KbError):
            wrong()
    kb.delete("p")
    assert kb.names == ["q", "r"] and rows(kb.constants()) == [("b",), ("e",)]


def test_a_thousand_single_changes(spark):
    import random

    draw, kb, want = random.Random(3), small(spark), {("a", "b"), ("a", "c"), ("d", "b")}
    for i in range(1000):
        r = (f"x{draw.randrange(40)}", f"y{draw.randrange(5)}")
        (kb.add if draw.random() < 0.6 else kb.remove)("p", [r])
        want = want | {r} if (kb._staged["p"][r]) else want - {r}
        if i in (3, 500):
            assert set(rows(kb["p"])) == want and kb["p"].count() == len(want)
    assert set(rows(kb["p"])) == want and kb["p"].count() == len(want)
    joins = lambda: kb["p"]._jdf.queryExecution().optimizedPlan().toString().count("Join")
    most = MOST_CHANGES * (MOST_CHANGES + 1) // 2  # Spark puts an anti-join into both sides of the unions below it
    assert 0 < joins() <= most
    for i in range(2 * MOST_CHANGES + 1):
        kb.add("p", [(f"n{i}", "z")])
        assert kb["p"].filter(f"c0 = 'n{i}'").count() == 1
        assert joins() <= most
    # a record that goes and comes again is not entailed any more
    kb.entail("p", [("a", "b"), ("d", "b")])
    kb.remove("p", [("a", "b")])
    kb.add("p", [("a", "b")])
    assert rows(kb.entailed["p"]) == [("d", "b")] and ("a", "b") in rows(kb.not_entailed("p"))


def test_versions(spark, tmp_path):
    import random

    draw, log, now, old = random.Random(7), VersionedRelation(spark, str(tmp_path / "v"), 2), set(), {0: set()}
    for version in range(1, 25):
        for _ in range(draw.choice((1, 1, 1, 40))):
            r = (f"x{draw.randrange(20)}", f"y{draw.randrange(4)}")
            kept = draw.random() < 0.6
            (log.add if kept else log.remove)([r])
            now = now | {r} if kept else now - {r}
        assert log.commit() == version
        old[version] = now
    again = VersionedRelation(spark, str(tmp_path / "v"), 2)
    assert again.version == 24 and again.segments == log.segments
    for version, want in old.items():
        got = rows(again.at(version))
        assert got == sorted(want), version
    base, changes = log._cover(24)
    assert base is not None and len(changes) < 6
    assert {(*r[:2], r[2]) for r in rows(log.changed(5, 20))} == {(*r, True) for r in old[20] - old[5]} | {(*r, False) for r in old[5] - old[20]}
    # DataFrames; nulls do not enter, and of a record that goes and comes the coming counts
    n = log.commit(added=spark.createDataFrame([("x", "1"), (None, "2")], "a string, b string"), removed=spark.createDataFrame([("x", "1"), *sorted(now)], "a string, b string"))
    assert n == 25 and rows(log.at()) == [("x", "1")] and rows(log.at(24)) == sorted(now)
    assert log.commit() == 25  # nothing to say, no version
    # another writer was first
    again.add([("late", "1")])
    with pytest.raises(KbError, match="there already"):
        again.commit()
    assert rows(VersionedRelation(spark, str(tmp_path / "v"), 2).at()) == [("x", "1")]
    for wrong in (lambda: log.at(99), lambda: log.add([("a",)]), lambda: VersionedRelation(spark, "x", 0)):
        with pytest.raises(KbError):
            wrong()


def test_nulls_do_not_enter(spark):
    kb = KnowledgeBase(spark).attach("n", spark.createDataFrame([("a", None), ("a", "b")], "x string, y string"))
    assert rows(kb["n"]) == [("a", "b")]


def test_numbers(spark):
    kb = small(spark)
    numbers = kb.numeration()
    got = dict(rows(numbers))
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == ["a", "b", "c", "d", "e", "p", "q"] and sorted(got.values()) == list(range(1, 8))
    assert rows(kb.decoded(kb.encoded("p", numbers), numbers)) == rows(kb["p"])
    m = NameMap(["x", "y", "z"])
    assert m.unmap("y") == 2 and m.map("w") == 2 and m.map("x") == 1 and len(m) == 3
    assert m.unmap_number(1) == "x" and m.items() == [(2, "w"), (3, "z")] and m.unmap("none") == 0


def test_profiles(spark):
    kb = KnowledgeBase(spark).attach_rows("p", [("a", str(i)) for i in range(3)] + [("b", "x")]).attach_rows("q", [("a",), ("c",)])
    assert rows(profile.promising_constants(kb, 0.5).select("rel", "pos", "val", "n")) == [("p", 0, "a", 3), ("q", 0, "a", 1), ("q", 0, "c", 1)]
    assert rows(profile.promising_constants(kb, 0.5, strict=True).select("rel", "val")) == [("p", "a")]
    j = {(r["rel1"], r["pos1"], r["rel2"], r["pos2"]): r["jaccard"] for r in profile.column_jaccard(kb).collect()}
    assert j == {("p", 0, "q", 0): pytest.approx(1 / 5)}
    s = profile.statistics(kb, 0.5, 0.1).first()
    assert (s["facts"], s["functors"], s["constants"], s["similar_pairs"], s["column_pairs"]) == (6, 2, 7, 1, 3)
    assert profile.pivot([(0, [["a"]]), (0.5, [["a"], ["b"], ["c"]]), (1, [["a"], ["b"], ["c"], ["d"]])]) == 1
    assert sorted(profile.split(kb)) in ([["p"], ["q"]], [["p", "q"]])
    assert profile.split(kb, 2) == [["p"], ["q"]] and profile.components_at(["a", "b", "c"], [("a", "b", 0.5)], 0.5) == [["a", "b"], ["c"]]


def test_generated_families(spark):
    for size, count in (("tiny", 8), ("simple", 24), ("medium", 110)):
        assert datagen.triples(spark, size, 3).count() == 3 * count
    noisy = datagen.triples(spark, "medium", 50, error=0.2)
    assert noisy.count() < 50 * 110 and rows(noisy) == rows(datagen.triples(spark, "medium", 50, error=0.2))


def test_text_facts(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("p\ta\tb\n\nq\tc\np\ta\tb\n")
    kb = facts.read_facts(spark, str(tmp_path / "in.tsv"))
    assert rows(kb["p"]) == [("a", "b")] and rows(kb["q"]) == [("c",)]
    facts.write_facts(kb, str(tmp_path / "out"))
    assert rows(facts.read_facts(spark, str(tmp_path / "out")).facts()) == rows(kb.facts())
    (tmp_path / "bad.tsv").write_text("p\ta\np\ta\tb\n")
    with pytest.raises(ValueError, match="arguments"):
        facts.read_facts(spark, str(tmp_path / "bad.tsv"))


def test_native_folder(spark, tmp_path):
    kb = small(spark)
    kb.create("empty", 3)
    store.write_kb(kb, str(tmp_path / "kb"), dictionary=True)
    back = store.read_kb(spark, str(tmp_path / "kb"), check=spark.read.parquet(str(tmp_path / "kb" / "dictionary")))
    assert back.names == kb.names and back.arity("empty") == 3 and rows(back.facts()) == rows(kb.facts())
    with pytest.raises(KbError):
        store.read_kb(spark, str(tmp_path / "kb"), check=spark.createDataFrame([("a",)], "name string"))


def test_binary_folder(spark, tmp_path):
    names = "family mother father alice bob catherine diana erick frederick gabby harry isaac jena kyle lily marvin nataly".split()
    (tmp_path / "map1.tsv").write_text("".join(f"{n}\t{i:x}\n" for i, n in enumerate(names, 1)))
    (tmp_path / legacy.file_name("family", 3, 4)).write_bytes(legacy.encode_ints([4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]) + b"\1\0")
    (tmp_path / "father.ceg").write_bytes(legacy.encode_ints([16, 17, 14, 15]))
    (tmp_path / "rules.hyp").write_text("father(X0,X1):-family(?,X0,X1)\n")
    (tmp_path / "supplementary.cst").write_bytes(legacy.encode_ints([4]))
    kb = legacy.read_folder(spark, str(tmp_path))
    assert rows(kb["family"])[0] == ("alice", "bob", "catherine") and kb["family"].count() == 4
    c = legacy.read_compressed(spark, str(tmp_path), {"father": 2})
    assert rows(c.counterexamples["father"]) == [("kyle", "lily"), ("marvin", "nataly")] and rows(c.supplementary) == [("alice",)] and [str(r) for r in c.rules] == ["father(X0,X1):-family(?,X0,X1)"]
    legacy.write_folder(kb, str(tmp_path / "out"))
    assert rows(legacy.read_folder(spark, str(tmp_path / "out"))["family"]) == rows(kb["family"])
    assert legacy.parse_file_name("/x/a_b_2_10.rel") == ("a_b", 2, 10)
    (tmp_path / legacy.file_name("bad", 1, 1)).write_bytes(legacy.encode_ints([99]))
    with pytest.raises(KbError):
        legacy.read_folder(spark, str(tmp_path))


def test_binary_ranges_and_parts(spark, tmp_path):
    df = spark.range(0, 10_007, 1, 7).selectExpr("id AS c0", "id % 13 AS c1", "-id AS c2")
    parts, file = str(tmp_path / "p"), str(tmp_path / "a b%20c" / "rel.rel")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "part-left").write_bytes(b"of an attempt that was lost")
    found = binary.write_parts(df, parts)
    assert len(found) == 7 and sum(n for _, n in found) == 10_007 * 12 and not (tmp_path / "p" / "part-left").exists()
    binary.joined(spark, parts, found, file)
    assert [p.name for p in (tmp_path / "a b%20c").iterdir()] == ["rel.rel"]
    data = Path(file).read_bytes()
    assert data == np.array([[i, i % 13, -i] for i in range(10_007)], "<i4").tobytes()  # order of partitions, then of rows
    back = binary.read_rows(spark, file, 3, range_bytes=10_000)
    assert back.rdd.getNumPartitions() == 13 and sorted(map(tuple, back.collect())) == [(i, i % 13, -i) for i in range(10_007)]
    # a stream gives the same file, and a cut row is left out
    size = sum(f["size"].sum() for f in binary._streamer("file://" + parts, f"file://{tmp_path}/streamed", [n for n, _ in found])([None]))
    assert size == len(data) and (tmp_path / "streamed").read_bytes() == data
    (tmp_path / "streamed").write_bytes(data[:-5])
    assert binary.read_rows(spark, str(tmp_path / "streamed"), 3).count() == 10_006
    # nothing to write, nothing to read
    binary.joined(spark, str(tmp_path / "q"), binary.write_parts(df.limit(0), str(tmp_path / "q")), str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b"" and binary.read_rows(spark, str(tmp_path / "none"), 3).count() == 0
    with pytest.raises(Exception, match="32 bits"):
        binary.write_parts(spark.range(2**31, 2**31 + 2), str(tmp_path / "wide"))


def test_binary_file_beyond_two_gigabytes(tmp_path):
    n = 700_000_001  # 2.8 GB, which take no room: only the end is written
    with open(tmp_path / "big", "wb") as f:
        f.seek(4 * n - 4)
        f.write(legacy.encode_ints([7]))
    reader = binary._Reader(f"file://{tmp_path}/big", 1, binary.RANGE_BYTES)
    ranges = reader.partitions()
    assert len(ranges) == 42 and all(a.stop == b.start for a, b in zip(ranges, ranges[1:])) and ranges[-1].stop == 4 * n
    tail = [x for batch in reader.read(ranges[-1]) for x in batch.column(0).to_pylist()]
    assert len(tail) == (ranges[-1].stop - ranges[-1].start) // 4 and tail[-1] == 7 and not any(tail[:-1])


def test_binary_maps_are_replaced(spark, tmp_path):
    kb = KnowledgeBase(spark).attach_rows("p", [(f"x{i}", f"y{i % 3}") for i in range(200)])
    (tmp_path / "map99.tsv").write_text("old\tff\n")
    legacy.write_folder(kb, str(tmp_path))
    assert not (tmp_path / "map99.tsv").exists() and not list(tmp_path.glob("_parts*"))
    assert rows(legacy.read_folder(spark, str(tmp_path))["p"]) == rows(kb["p"])
    assert rows(legacy.read_map(spark, str(tmp_path))) == rows(kb.numeration())


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(("p\ta\tb\nq\tc\n", "p\ta\tb\np\tx\ty\n")):
        (tmp_path / "in" / f"{i}.tsv").write_text(lines)
        intake(fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    held = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["rel"], *r["args"]) for r in held.collect()) == [("p", "a", "b"), ("p", "x", "y"), ("q", "c")]
    assert held.filter(F.col("rel") == "p").count() == 2


def test_constants_and_columns_reach_the_scan(spark, tmp_path):
    from factweave.plans.compile import RulePlan, selected
    from factweave.plans.rule import parse_rule

    spark.createDataFrame([(str(i), str(i % 7), "x") for i in range(100)], "a string, b string, c string").write.parquet(str(tmp_path / "r"))
    for known in (True, False):
        kb = KnowledgeBase(spark).attach("r", spark.read.parquet(str(tmp_path / "r")), known_set=known)
        plan = selected(kb, parse_rule("r(?,'3',?):-").head)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(b,3)" in plan
    body = RulePlan(kb, parse_rule("r(X,?,?):-r(?,X,?)")).body()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in body
    kb = KnowledgeBase(spark).attach("r", spark.read.parquet(str(tmp_path / "r")), known_set=True)
    body = RulePlan(kb, parse_rule("r(X,?,?):-r(?,X,?)")).body()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:string>" in body


def test_data_sets_by_name(spark, tmp_path):
    from factweave.sources.datasets import Registry

    (tmp_path / "f.tsv").write_text("p\ta\n")
    r = Registry()
    r.add("Facts of P", str(tmp_path / "f.tsv"), "fp")
    assert rows(r.load(spark, "fp")["p"]) == [("a",)] and r["Facts of P"] is r["fp"]
    with pytest.raises(KbError):
        r["none"]
    with pytest.raises(KbError):
        r.add("other", "x", "fp")


def test_clusters_need_a_shared_folder(spark):
    from factweave.sources import shared

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, given=None):
            self.sparkContext, self.given = Context(master), given
            self.conf = self

        def get(self, key, default=None):
            return self.given or default

    with pytest.raises(shared.NoSharedFolder):
        shared.shared_dir(Session("spark://host:7077"))
    assert shared.shared_dir(Session("spark://host:7077", "hdfs://all/see/")) == "hdfs://all/see"
    assert shared.shared_dir(Session("local[2]")).startswith("file://")
    df = shared.written(spark.range(3).toDF("x"), "small")
    assert rows(df) == [(0,), (1,), (2,)]
    shared.done_with(df)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.schema("x long").parquet(df._factweave_path).collect()
