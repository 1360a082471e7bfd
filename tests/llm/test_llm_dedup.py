"""Operators 3, 5 and 6 against plain versions."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from factweave.llm import common, components, lines, passages, simhash


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _lines string, fp string")


def rows_of(texts):
    return [(i, t, len(t or ""), "x", "y") for i, t in enumerate(texts)]


# -- lines -------------------------------------------------------------------------------


def plain_lines(rows):
    """Text left of each row, by the rule's words."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, gone = {}, {i: set() for i in range(len(rows))}
    split = [(r[1] or "").split("\n") for r in rows]
    for i in order:
        own = [x.strip(" \t\r") for x in split[i]]
        for p in range(len(own) - 2):
            key = tuple(own[p : p + 3])
            if key == ("", "", ""):
                continue
            if key not in first:
                first[key] = (i, p)
            else:
                d, q = first[key]
                gone[i] |= set(range(max(p, q + 3) if d == i else p, p + 3))
    return ["\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]) for i in range(len(rows))]


def line_rows():
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "same "]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(60)]
    texts += ["a\nb\nc\nd", "a\nb\nc\nd", "z\na\nb \nc", "r\nr\nr\nr\nr\nr", None, "", "one", "x\r\ny\r\nz\r\n", "x\ny\nz", "q\n" * 3000 + "end"]
    return [*rows_of(texts), (None, "a\nb\nc", 5, "x", "y"), (3, texts[3], 0, "x", "y")]


def test_line_dedup(spark):
    rows = line_rows()
    out = lines.deduplicated(documents(spark, rows).coalesce(1))
    assert out.columns == ["doc_id", "text", "n_chars", "_lines", "fp"]
    want = plain_lines(rows)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], t) for r, t in zip(rows, want, strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert lines.deduplicated(documents(spark, [])).count() == 0


def test_line_report_equals_sql(spark):
    rows = [r for r in line_rows() if r[0] is not None][:-1]
    found = sorted(map(tuple, lines.report(documents(spark, rows)).select("doc_id", "n_lines", "n_removed", "removed", "kept_sha256").collect()))
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert found == sorted(db.execute(lines.SQL).fetchall())


def test_line_dedup_runs_no_python(spark):
    plan = lines.report(documents(spark, line_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- fingerprints ------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_every_pair_within_the_radius_shares_a_table():
    tables = simhash.masks()
    assert len(tables) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not (1 << i | 1 << j) & m for m in tables)


def near_rows():
    rng = random.Random(5)
    words = [f"W{i}" for i in range(40)]
    base = [rng.choices(words, k=60) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(c))
    return [*texts, None, "", " \t\n", "one", "One two", "éa É b c", texts[0], "w " * 5000]


def test_simhash_groups(spark):
    texts = near_rows()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows_of(texts))).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components(prints)
    for i in range(len(texts)):
        assert found[i]["fingerprint"] == f"{prints[i]:016x}"
        assert found[i]["component_id"] == want[i]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_of_crowded_buckets_are_whole(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(20):
        a = rng.getrandbits(64)
        for _ in range(30):
            b = a
            for _ in range(rng.randint(0, 4)):
                b ^= 1 << rng.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = plain_components(prints)
    for i in range(len(prints)):
        for j in range(i):
            assert (want[i] == want[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))


def test_one_of_each_group_stays(spark):
    texts = near_rows()
    rows = [*rows_of(texts), (0, texts[0], 0, "x", "y"), (None, "without an id", 0, "x", "y"), (None, "without an id", 0, "x", "y")]
    out = simhash.deduplicated(documents(spark, rows))
    assert out.columns == ["doc_id", "text", "n_chars", "_lines", "fp"]
    want = plain_components([plain_fingerprint(t) for t in texts])
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want)) and kept.count(None) == 1


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and found[1001] == 1000
    assert components.components(edges.limit(0)).count() == 0


# -- passages ----------------------------------------------------------------------------


def passage_rows():
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    shared = [text(70) for _ in range(4)]
    out = []
    for i in range(40):
        body = text(150)
        if i < 24:
            words = body.split(" ")
            at = rng.randrange(100)
            body = " ".join(words[:at]) + " " + (shared[i % 4].upper() if i % 3 == 0 else shared[i % 4]) + "\n" + " ".join(words[at:])
        out.append(body)
    return out, shared


def test_passages_go_from_all_but_the_first(spark):
    texts, shared = passage_rows()
    found = passages.removed(documents(spark, rows_of(texts))).collect()
    assert {r["doc_id"] for r in found} == set(range(4, 24))
    for r in found:
        part = texts[r["doc_id"]][r["start"] : r["stop"]]
        assert r["kept_doc_id"] < r["doc_id"] and (r["doc_id"] - r["kept_doc_id"]) % 4 == 0 and len(part.split()) == r["n_words"]
        assert part.lower() in shared[r["doc_id"] % 4]
        assert r["n_words"] >= 70 - 2 * passages.WINDOW - 1
    kept = {r["doc_id"]: r["text"] for r in passages.deduplicated(documents(spark, rows_of(texts))).collect()}
    assert all(kept[i] == texts[i] for i in [*range(4), *range(24, 40)])
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["stop"]] not in kept[r["doc_id"]]


def test_units_do_not_depend_on_their_place():
    texts, shared = passage_rows()
    alone = {int(d) for d in passages.units(shared[0].encode())[0]}
    inside = {int(d) for d in passages.units(("Über " + shared[0].replace(" ", "  \t") + " end\n").encode())[0]}
    assert len(alone) >= 4 and len(alone & inside) >= len(alone) - 3  # but for the line itself and the ends
    assert passages.units(b"")[0].size == 0 and passages.units(b" \n ")[0].size == 0


def lines_that_are_units(*texts):
    """For each text of one batch the lines that are units."""
    batch = pa.RecordBatch.from_pydict({"_rid": list(range(len(texts))), "rank": list(range(len(texts))), "text": list(texts)})
    (found,) = passages._cut_batch(batch)
    return [{t[a:b] for a, b in zip(x, y, strict=True) if "\n" not in t[a:b] and t[a:b] in t.split("\n")} for t, x, y in zip(texts, found.column("starts").to_pylist(), found.column("stops").to_pylist(), strict=True)]


def test_a_unit_is_one_after_any_text_and_in_any_batch():
    rng = random.Random(31)
    for _ in range(400):
        letters = "abcdefgh"[: rng.randint(2, 8)]
        line = " ".join(rng.choice(letters) for _ in range(rng.randint(passages.LINE_WORDS, 24)))
        words = line.split()
        varied = 2 * sum(w in words[max(0, i - passages.PERIOD) : i] for i, w in enumerate(words)) <= len(words)
        before = " ".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
        alone, behind, after_others = lines_that_are_units(line)[0], lines_that_are_units(before + "\n" + line)[0], lines_that_are_units(before, before * 3, line)[2]
        assert (line in alone) == (line in behind) == (line in after_others) == varied


def test_units_of_equal_digest_are_equal():
    by_digest = {}
    for t in passage_rows()[0]:
        data = t.encode()
        for d, a, b, n in zip(*passages.units(data), strict=True):
            words = data[a:b].lower().split()
            assert len(words) == n
            assert by_digest.setdefault(int(d), words) == words


def test_passage_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(120_000))
    texts = [None, "", " \n\t", "few words", "few words", long, long, "öä " * 40, "du " * 60, "x" * 50_000]
    rows = [*rows_of(texts), (None, long, 1, "x", "y"), (5, long, 1, "x", "y")]
    out = passages.deduplicated(documents(spark, rows).coalesce(1))
    assert out.columns == ["doc_id", "text", "n_chars", "_lines", "fp"]
    left = {}
    for r in out.collect():
        left.setdefault(r["doc_id"], []).append(r["text"])
    assert sorted(map(len, map(str.split, left[5])))[-1] == 120_000 and min(len(t) for t in left[5]) < 1000
    assert len(left[6][0]) < 1000 and left[3] == left[4] == ["few words"]
    assert all(len(t) < 1000 for t in left[None])
    assert passages.deduplicated(documents(spark, [])).count() == 0 and passages.removed(documents(spark, [])).count() == 0


def test_large_findings_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [*line_rows(), *rows_of(passage_rows()[0])]
    docs = documents(spark, rows).coalesce(1)
    order = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    functions = (lines.deduplicated, passages.deduplicated, simhash.deduplicated)
    small = [order(f(docs)) for f in functions]
    monkeypatch.setattr(common, "BROADCAST_CELLS", -1)
    assert [order(f(docs)) for f in functions] == small


def plain_left(texts, words=51):
    """Places of windows of so many words that stand elsewhere too."""
    places = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        for p in range(len(w) - words + 1):
            places.setdefault(tuple(w[p : p + words]), []).append((i, p))
    return [p for p in places.values() if len(p) > 1]


def test_no_passage_of_51_words_is_left(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randint(5, 9))) for _ in range(n)]
    texts = []
    for i in range(600):
        passage = text(51 + i % 4)
        for wrapped in (False, i % 3 == 0):
            shown = list(passage)
            for at in rng.sample(range(1, 50), 3 if wrapped else 0):
                shown[at] = "\n" + shown[at]
            texts.append(" ".join([*text(rng.randint(0, 30)), *shown, *text(rng.randint(0, 30))]))
    assert len(plain_left(texts)) >= 600
    cuts = []
    for chunk in (passages.CHUNK, 300):  # pieces of 300 bytes end inside the passages
        monkeypatch.setattr(passages, "CHUNK", chunk)
        monkeypatch.setattr(passages.chunks, "__defaults__", (chunk,))
        batch = pa.RecordBatch.from_pydict({"_rid": list(range(len(texts))), "rank": list(range(len(texts))), "text": texts})
        (out,) = passages._cut_batch(batch)
        cuts.append(out.to_pylist())
    assert cuts[0] == cuts[1]
    kept = {r["doc_id"]: r["text"] for r in passages.deduplicated(documents(spark, rows_of(texts))).collect()}
    left = [kept[i] for i in range(len(texts))]
    assert left[::2] == texts[::2] and not plain_left(left)


# The mixing of words into hashes, by itself, one by one.

_ALL = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def plain_units(text):
    """Kind, first word and end of every unit, and the words of the text: lines, paragraphs, windows."""
    lines = [x.split() for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split("\n")]
    words = [w for x in lines for w in x]
    found, at, paragraph = [], 0, []
    for x in [*lines, []]:
        if x:
            found.append(("line", at, at + len(x)))
            paragraph.append((at, at + len(x)))
            at += len(x)
        elif paragraph:
            if len(paragraph) > 1:
                found.append(("paragraph", paragraph[0][0], at))
            paragraph = []
    found = [u for u in found if u[2] - u[1] >= passages.LINE_WORDS]
    hashed = []
    for w in words:
        h = sum((b + 1) * pow(passages._BASE, i, 1 << 64) for i, b in enumerate(w.encode())) & _ALL
        hashed.append(plain_mix((h + len(w.encode())) & _ALL))
    pairs = [plain_mix((h + (hashed[i - 1] if i else 0) * passages._BASE) & _ALL) for i, h in enumerate(hashed)]
    begins = set()
    for i in range(len(words) - passages.WINDOW + 1):
        part = pairs[i : i + passages.WINDOW]
        begins.add(i + max(k for k, p in enumerate(part) if p == min(part)))
    found += [("window", i, i + passages.RUN_WORDS) for i in begins if i + passages.RUN_WORDS <= len(words)]
    varied = lambda unit: 2 * sum(w in unit[max(0, i - passages.PERIOD) : i] for i, w in enumerate(unit)) <= len(unit)
    return sorted((a, kind, b) for kind, a, b in found if varied(words[a:b])), words


def plain_removed(texts):
    """For each document the words that go."""
    gone, first = [], {}
    for i, t in enumerate(texts):
        found, words = plain_units(t or "")
        out, own = set(), {}
        for a, kind, b in found:
            key = (kind, *words[a:b])
            if key in own:
                if a >= own[key]:
                    out |= set(range(a, b))
                continue
            own[key] = b
            if first.setdefault(key, i) != i:
                out |= set(range(a, b))
        gone.append(out)
    return gone


def test_removed_spans_equal_a_plain_version(spark):
    rng = random.Random(21)
    text = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]
    pool = [" ".join(text(rng.randint(5, 45))) for _ in range(25)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(text(rng.randint(1, 40))) for _ in range(rng.randint(0, 8))]
        texts.append("".join(p + rng.choice(["\n", " ", "\n\n", "\n \n", "\t"]) for p in parts))
    texts += [None, "", "word " * 200, "one two three " * 60, "\n".join([max(pool, key=len)] * 5), texts[0], texts[0].upper()]
    want = plain_removed(texts)
    spans = {}
    for r in passages.removed(documents(spark, rows_of(texts)).coalesce(1)).collect():
        before = len(texts[r["doc_id"]][: r["start"]].split())
        spans.setdefault(r["doc_id"], set()).update(range(before, before + r["n_words"]))
    assert {i: g for i, g in enumerate(want) if g} == spans
    assert not want[122] and not want[123] and want[124]


def test_first_of_rows_of_equal_rank_stays(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    for doc_id in (7, None):
        rows = documents(spark, [(doc_id, text, len(text), "x", "y")] * 3).repartition(3).selectExpr("monotonically_increasing_id() AS _rid", "doc_id", "text")
        rows = common.stage(rows, "rows")
        first, *others = sorted(r["_rid"] for r in rows.select("_rid").collect())
        found = {(r["_rid"], r["n_words"]) for r in passages.spans(rows).collect()}
        assert found == {(i, 2000) for i in others}


def test_hot_keys_are_joined_in_place(spark):
    rows = spark.range(9000).selectExpr("id", "IF(id < 5000, 'hot', concat('k', id % 7)) AS key")
    found = common.stage(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")), "found")
    out = common.spread_join(rows, found, "key", bound=4)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("id", "key", "least").collect())) == sorted(map(tuple, rows.join(found.drop("n"), "key").select("id", "key", "least").collect()))
    assert common.spread_join(rows, found, "key", bound=1).count() == 9000


def test_rows_behind_a_shuffle_are_staged_before_they_are_numbered(spark):
    plain = spark.range(10).selectExpr("id AS doc_id", "'t' AS text")
    assert common.scanned(plain) is plain or plain.count() == 10
    shuffled = common.stage(plain, "plain").repartition(3)
    assert common.scanned(shuffled) is not shuffled and "repartition" not in common.scanned(shuffled)._jdf.queryExecution().optimizedPlan().toString().lower()
    held = common.stage(plain, "plain").filter("doc_id > 2").select("doc_id", "text")
    assert common.scanned(held) is held
