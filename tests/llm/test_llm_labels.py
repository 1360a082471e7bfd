"""Operators 4, 7 and 10: the law of shards, accuracy on held-out rows, roles found again."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import chat, shards, toxicity

# -- shards ------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, score string")


def test_shards(spark):
    rows = [(i, f"text {i} é", "x", "y") for i in range(3000)] + [(7, "text 7 é", "x", "y")] * 50 + [(None, None, None, None)] * 40
    out = shards.shard(documents(spark, rows).repartition(5), 16).collect()
    assert len(out) == len(rows)
    slots: dict = {}
    for r in out:
        text = "" if r["doc_id"] is None else f"text {r['doc_id']} é"
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    for key in (7, None):
        assert len({r["shard"] for r in out if r["doc_id"] == key}) == 1
    counts = Counter(r["shard"] for r in out if r["doc_id"] not in (7, None))
    assert max(counts.values()) < 1.4 * 3000 / 16 and sum(r["grown_shard"] == 16 for r in out) > 100
    assert shards.shard(documents(spark, []), 16).count() == 0


@pytest.mark.parametrize("n", range(1, 9))
def test_a_further_shard_only_takes(spark, n):
    one = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in shards.shard(documents(spark, [(i, "", "", "") for i in range(500)]), n).collect()}
    assert all(b in (a, n) for a, b in one.values())


def plain_shard(key, leaves):
    """Descends the tree by itself: at each level the child of least draw."""

    def draw(path, weight):
        h = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    left, path = leaves, ""
    for level in ("region", "rack", "shard"):
        weights = {}
        for x in left:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0) + x.weight
        names = {child: f"{path}{level} {child}" for child in weights}
        chosen = min(weights, key=lambda c: (draw(names[c], weights[c]), c)) if len(weights) > 1 else next(iter(weights))
        left, path = [x for x in left if getattr(x, level) == chosen], names[chosen] + " "
    return left[0].shard


@pytest.mark.parametrize(("n", "weights"), [(16, {}), (7, {2: 5.0, 6: 0.25}), (1, {})])
def test_shards_equal_a_plain_descent(spark, n, weights):
    found = shards.shard(documents(spark, [(i, "", "", "") for i in range(300)] + [(None, "t" * 200_000, "", "")]), n, weights=weights).collect()
    leaves = shards.tree(n, weights)
    for r in found:
        key = "null key" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain_shard(key, leaves), plain_shard(key, shards.grown(leaves)))


def test_a_weight_moves_rows_through_its_own_subtrees_only(spark):
    df = documents(spark, [(i, "", "", "") for i in range(6000)])
    before = {r["doc_id"]: r["shard"] for r in shards.shard(df, 16).collect()}
    after = {r["doc_id"]: r["shard"] for r in shards.shard(df, 16, weights={5: 2.0}).collect()}
    place = {x.shard: (x.region, x.rack) for x in shards.tree(16)}
    for i, a in before.items():
        if a != after[i]:  # into region 1, in it into rack 0, in that onto shard 5
            b, (region, rack) = after[i], place[after[i]]
            assert region == 1 and (place[a][0] != 1 or rack == 0) and (place[a] != (1, 0) or b == 5)
    assert Counter(after.values())[5] == pytest.approx(6000 * 2 / 17, rel=0.12)


# -- toxicity ----------------------------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(seed=8, n=900):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    plain = [word() for _ in range(400)]
    bad = ["zorgle", "blimwit", "frakkop", "snivelor"]
    rows, marks = [], {}
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        marks[i] = int(rng.random() < 0.2)
        if marks[i]:
            for _ in range(2 + len(words) // 40):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), {0: w, 1: w.upper(), 2: w.replace("o", "0").replace("i", "1"), 3: w.replace("o", "о")}[rng.randrange(4)])
        rows.append((i, " ".join(words), "x", "y"))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = labelled()
    rows += [(5000, None, None, None), (5001, "", "", ""), (None, "zorgle blimwit", "", "")]
    labels = spark.createDataFrame([(i, m, "x") for i, m in marks.items()] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.judged(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in out)
    tried = [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in out if r["doc_id"] in marks and held(r["doc_id"])]
    right = np.mean([p == m for _, p, m in tried])
    pos, neg = [s for s, _, m in tried if m], [s for s, _, m in tried if not m]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in product(pos, neg)])
    assert len(pos) > 20 and right > 0.97 and auc > 0.99


def test_weights_equal_plain_counts(spark):
    rows, marks = labelled(n=240)
    lexicon = toxicity.fit(documents(spark, rows), spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"))
    seen = [(set(toxicity.fold(t).split()), marks[i]) for i, t, *_ in rows if not held(i)]
    number = Counter(m for _, m in seen)
    least = max(3, math.ceil(0.008 * number[1]))

    def odds(entry):
        has = lambda words: entry.strip() in words if entry.endswith(" ") else any(w.startswith(entry.strip()) for w in words)
        n = Counter(m for words, m in seen if has(words))
        return n[1], math.log((n[1] + 0.5) / (number[1] + 1)) - math.log((n[0] + 0.5) / (number[0] + 1))

    for entry, weight in lexicon.weights.items():
        n, want = odds(entry)
        assert n >= least and weight == pytest.approx(want) and want >= toxicity.LEAST_WEIGHT
    every = {e for words, m in seen if m for e in toxicity.entries(" " + " ".join(words) + " ")}
    strong = {e for e in every if odds(e)[0] >= least and odds(e)[1] >= toxicity.LEAST_WEIGHT}
    # what is left out has a longer entry for nearly all of its documents, or a shorter one that says as much
    assert set(lexicon.weights) <= strong
    for e in strong - set(lexicon.weights):
        longer = [x for x in strong if x != e and e in toxicity.shorter(x)]
        assert any(odds(x)[0] >= 0.9 * odds(e)[0] for x in longer) or any(lexicon.weights.get(x, 0) >= odds(e)[1] for x in toxicity.shorter(e))


def test_held_out_labels_do_not_matter(spark):
    rows, marks = labelled(n=300)
    make = lambda flip: spark.createDataFrame([(i, 1 - m if flip and held(i) else m) for i, m in marks.items()], "doc_id long, toxic int")
    a, b = (toxicity.fit(documents(spark, rows), make(f)) for f in (False, True))
    assert a.weights == b.weights and a.coefficients == pytest.approx(b.coefficients)


def test_matches_equal_a_plain_search():
    lexicon = toxicity.Lexicon({" zorg": 2.0, " zorgle ": 3.0, " blim ": 1.5}, exceptions=("zorgle bird",), coefficients=(-1.0, 1.0, 1.0))

    def plain(text):
        words = toxicity.fold(text).split()
        weights = {}
        total = 0.0
        for i, w in enumerate(words):
            if w == "zorgie" and words[i + 1 : i + 2] == ["bird"]:
                continue
            best = max(((x, e) for e, x in lexicon.weights.items() if (f" {w} ".startswith(e) if not e.endswith(" ") else f" {w} " == e)), default=None)
            if best:
                total += best[0]
                weights[best[1]] = best[0]
        return math.log1p(100 * total / (toxicity.fold(text).count(" ") + 20)), math.log1p(sum(weights.values()))

    lexicon.weights = {toxicity.fold(e)[: len(e)] if e.endswith(" ") else " " + toxicity.fold(e).strip(): w for e, w in lexicon.weights.items()}
    for text in ("Z0RGLE zorgly, blim.", "a zorgle bird and a zorgle", "nothing", "", "zorg blimp blim zоrgle", "x" * 1000, "zorgle bird " * 20_000 + "zorgle", "blim " * 60_000):
        assert lexicon.features(text) == pytest.approx(plain(text)), text
    assert lexicon.score("") == pytest.approx(1 / (1 + math.e))


def test_exceptions_are_learnt(spark):
    """A word that is toxic by itself and harmless beside another one."""
    rows, marks = labelled()
    rng = random.Random(12)
    more = []
    for i in range(900, 924):
        words = rows[i % 900][1].split()[:15] if not marks[i % 900] else [f"q{rng.randrange(60)}" for _ in range(15)]
        words.insert(rng.randrange(len(words)), "zorgle bird")
        more.append((i, " ".join(words), "x", "y"))
        marks[i] = 0
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    lexicon = toxicity.fit(documents(spark, rows + more), labels)
    assert any("zorgie bird" in p for p in lexicon.exceptions) and any("zorgi" in e for e in lexicon.weights)
    plain, excused = lexicon.features("a zorgle here"), lexicon.features("a zorgle bird here")
    assert plain[1] > 0 and excused == (0.0, 0.0)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(documents(spark, more), lexicon).selectExpr("doc_id", "int(score >= 0.7) predicted").collect()}
    assert not any(out[i] for i in out if held(i))


def test_without_both_classes(spark):
    docs = documents(spark, [(1, "a", "", ""), (2, "b", "", "")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.judged(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in toxicity.judged(docs, some).collect())
    assert toxicity.judged(documents(spark, []), some).count() == 0


def test_filter_keeps_columns(spark):
    lexicon = toxicity.Lexicon({" bad ": 5.0}, coefficients=(-3.0, 2.0, 1.0))
    out = toxicity.filtered(documents(spark, [(1, "bad bad", "s", "given"), (2, "fine words", "s", "given"), (3, None, None, None)]), lexicon)
    assert out.columns == ["doc_id", "text", "shard", "score"] and sorted((r["doc_id"], r["score"]) for r in out.collect()) == [(2, "given"), (3, None)]


# -- conversations -----------------------------------------------------------------------


def random_model(seed):
    rng = np.random.default_rng(seed)
    n = chat.STATES
    return chat.Model.counted(rng.random(n) * 10, rng.random((n, n)) * 10, {name: rng.random((n, k)) * 10 for name, k in chat.FEATURES.items()})


def path_score(m, e, p):
    return m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(e[t, s] for t, s in enumerate(p))


def test_viterbi_is_the_best_of_all_paths():
    m, rng = random_model(1), np.random.default_rng(2)
    for length in (1, 2, 4):
        e = np.log(rng.random((3, length, chat.STATES)))
        for one, path in zip(e, chat.viterbi(m.start, m.step, e), strict=True):
            best = max(product(range(chat.STATES), repeat=length), key=lambda p: path_score(m, one, p))  # noqa: B023
            assert tuple(path.tolist()) == best
            assert path[0] % 2 == 0 and all(b % 2 == 0 or a // 2 == b // 2 for a, b in zip(path, path[1:], strict=False))


def test_segments_give_the_same_path():
    m, rng = random_model(3), np.random.default_rng(4)
    e = np.log(rng.random((37, chat.STATES)))
    whole = chat.viterbi(m.start, m.step, e[None])[0].tolist()
    cuts = [0, 1, 9, 10, 30, 37]
    parts = [chat.between(m.step, e[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = chat.stitched(m, [s for s, _ in parts])
    assert [int(s) for (_, ways), p in zip(parts, pairs, strict=True) for s in ways[:, p]] == whole


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")


def talk(n=300, seed=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        t = 0
        if rng.random() < 0.2:
            rows.append((c, 0, "system", "be brief " * rng.randint(2, 4), "x"))
            t = 1
        for k in range(rng.randint(2, 8)):
            role = ("user", "assistant")[k % 2]
            text = "what is this thing? " * rng.randint(1, 2) if role == "user" else "this is the answer to it.\n" * rng.randint(5, 30)
            rows.append((c, t + k, role, text.strip(), "x"))
    return rows


def test_transcripts_are_parsed_back(spark):
    rows = talk()
    heads = [re.match(chat.HEAD, r["text"]) is not None for r in chat.flattened(turns(spark, rows).repartition(7)).collect()]
    assert len(heads) == len(rows) and 0.6 < np.mean(heads) < 0.9
    out = chat.parse(turns(spark, rows).repartition(7)).collect()
    assert len(out) == len(rows) and all(r["n_given"] == 1 for r in out)
    assert np.mean([r["parsed_role"] == r["role"] for r in out]) > 0.99
    assert np.mean([r["blind_role"] == r["role"] for r in out]) > 0.95
    text = {(c, t): x for c, t, _, x, _ in rows}
    for r in out:
        assert r["rendered"] == f"<|im_start|>{r['parsed_role']}\n{text[r['conv_id'], r['turn']].strip()}<|im_end|>\n"


def test_given_roles_are_no_observation(spark):
    """With a fitted model and the same transcripts, what the role column says makes no difference."""
    lines = chat.flattened(turns(spark, talk(60)))
    model = chat.fit(chat.laid_out(lines))
    strip = lambda df: sorted((r["conv_id"], r["turn"], r["parsed_role"], r["rendered"]) for r in chat.turns_of(chat.decoded(chat.laid_out(df), model)).collect())
    assert strip(lines) == strip(lines.withColumn("role", F.lit("tool"))) == strip(lines.withColumn("role", F.lit(None).cast("string")))


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(10)
    rows = [(1, i, None if i % 5 else ("human" if i % 2 == 0 else "bot"), "a question? " if i % 2 == 0 else "words of an answer.\n" * rng.randint(1, 9), "x") for i in range(4000)] + [(c + 100, *rest) for c, *rest in talk(20)]
    model = random_model(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        laid = chat.laid_out(chat.flattened(turns(spark, rows)))
        assert laid.select("_part").distinct().count() > 2
        out = {r["_at"]: r for r in chat.decoded(laid, model).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = {}
    for r in sorted(laid.collect(), key=lambda r: r["_at"]):
        lines.setdefault(r["conv_id"], []).append(r)
    assert len(out) == sum(map(len, lines.values()))
    for own in lines.values():
        seen = {name: np.array([r[name] for r in own]) for name in chat.FEATURES}
        for kind, markers in (("state", True), ("blind", False)):
            want = chat.viterbi(model.start, model.step, model.emissions(seen, markers)[None])[0].tolist()
            assert [out[r["_at"]][kind] for r in own] == want
            if markers:
                begun, starts = None, []
                for r, s in zip(own, want, strict=True):
                    begun = r["_at"] if s % 2 == 0 else begun
                    starts.append(begun)
                assert [out[r["_at"]]["start"] for r in own] == starts


def test_conversation_edge_cases(spark):
    long = "\n".join(f"line {i} of an answer" for i in range(30_000))
    rows = [(None, None, None, None, None), (None, 1, "USER", "hi", "x"), (2, 1, "nobody", "<|im_end|> text", "x"), (2, 1, "nobody", "<|im_end|> text", "x"), (3, 0, "assistant", "", "x"), (4, 0, "user", "go?", "x"), (4, 1, "assistant", long, "x"), *talk(40)[:200]]
    rows = [r if i < 7 else (r[0] + 10, *r[1:]) for i, r in enumerate(rows)]
    out = [r for r in chat.parse(turns(spark, rows)).collect() if r["conv_id"] is None or r["conv_id"] < 10]
    assert all(r["parsed_role"] in chat.ROLES and r["blind_role"] in chat.ROLES for r in out)
    assert [r["conv_id"] for r in out].count(None) == 1  # an empty turn without a role leaves no line
    by = {r["conv_id"]: r["rendered"] for r in out}
    assert by[None] == "<|im_start|>user\nhi<|im_end|>\n" and by[3] == "<|im_start|>assistant\n<|im_end|>\n" and by[2].count("<|im_end|>") == 1
    assert sum(r["n_lines"] for r in out if r["conv_id"] == 4) >= 30_001
    assert chat.parse(turns(spark, [])).count() == 0


def test_flat_transcripts(spark):
    model = chat.fit(chat.laid_out(chat.flattened(turns(spark, talk()))))
    text = "System: be brief\n\nUser: hi there\nhow are you?\n\nAssistant: fine, thanks.\nand you?\n\n**Human:** ok?"
    flat = spark.createDataFrame([(1, text), (2, "no markers"), (3, None)], "conv_id long, text string")
    found = {}
    for r in chat.parse_transcripts(flat, model).collect():
        found.setdefault(r["conv_id"], []).append((r["rendered"], r["parsed_role"]))
    assert sorted(role for _, role in found[1]) == ["assistant", "system", "user", "user"]
    assert any("hi there\nhow are you?" in t for t, _ in found[1]) and len(found[2]) == 1 and 3 not in found
