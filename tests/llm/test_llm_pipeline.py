"""The pipeline, stage by stage, against plain versions of its stages."""

import random

import corpus_pipeline
from factweave.llm import simhash, toxicity

from test_llm_dedup import plain_components, plain_fingerprint, plain_lines, plain_removed


def tables(spark, path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    pool = [word() for _ in range(500)]
    line = lambda: " ".join(rng.choices(pool, k=rng.randint(6, 14)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(200)]
    for i in range(0, 60, 3):
        texts[i] += " " + " ".join(["zorgle", "blimwit"] * 4)
    texts[100] = texts[90]
    texts[101] = texts[95].split("\n")[0]
    texts[95] = texts[101]
    texts[150] = "\n".join([*texts[120].split("\n"), line()])
    passage = " ".join(rng.choices(pool, k=80))
    for i in (160, 165, 170):
        head, _, tail = texts[i].partition(" ")
        texts[i] = f"{head} {passage} {tail}"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i < 60 and i % 3 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    seen = {}
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{i}")
        seen[name] = (kept, spark.read.parquet(f"{tmp_path}/stage-{i}"))
        kept = seen[name][1]
        if name != "packing":
            assert kept.columns == docs.columns
    order = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0))

    toxic = {r[0] for r in rows if r[0] is not None and r[0] < 60 and r[0] % 3 == 0}
    assert {i for i, _ in order(seen["toxicity"][1])} == {r[0] for r in rows} - toxic
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {i for i, t in order(docs) if lexicon.score(t or "") < toxicity.THRESHOLD} == {i for i, _ in order(seen["toxicity"][1])}

    before, after = (order(x) for x in seen["line_dedup"])
    assert [t for _, t in after] == plain_lines(before)

    before, after = (order(x) for x in seen["near_dedup"])
    groups = plain_components([plain_fingerprint(t) for _, t in before])
    assert [i for i, _ in after] == [before[g][0] for g in sorted(set(groups))]
    assert len(after) < len(before)

    before, after = (dict(order(x)) for x in seen["substring_dedup"])
    holds = lambda text: sum(passage.split()[k] in (text or "").split() for k in range(10, 70)) > 55
    assert [i for i in before if holds(before[i])] == [160, 165, 170] and [i for i in after if holds(after[i])] == [160]
    assert all(after[i] == before[i] for i in before if i not in (165, 170))
    in_order = sorted(before, key=lambda i: (i is None, i or 0))
    for i, gone in zip(in_order, plain_removed([before[i] for i in in_order]), strict=True):
        assert (after[i] or "").split() == [w for k, w in enumerate((before[i] or "").split()) if k not in gone]

    pieces = seen["packing"][1].collect()
    assert {p["doc_id"] for p in pieces} == set(after)
    for i in after:
        parts = [p for p in pieces if p["doc_id"] == i]
        assert sum(p["length"] for p in parts) == parts[0]["doc_tokens"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.deduplicated(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
