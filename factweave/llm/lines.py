"""Operator 3: line deduplication over overlapping windows of three lines, in DataFrame operations only.

Every three consecutive lines of a document are hashed.  Of a window that occurs more than
once anywhere, the earliest occurrence stays (by document id, then row, then position) and
the lines that later ones cover go, overlapping cover being merged.  Where a later window
overlaps its own earliest occurrence, the lines of that occurrence stay.  Each line that goes
has an earlier equal line, so one copy of every passage is left.

Lines are compared without blanks, tabs and carriage returns at their ends; windows of three
empty lines do not count.  Results: a null text is an empty one; documents of fewer than
three lines stay as they are; of repeated rows the later lose their lines; rows without an id
come last in the order; an empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, boxed, unboxed

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(rows: DataFrame) -> DataFrame:
    """``_rid``, ``rank`` (the document's id, nulls last), ``pos`` and ``key`` (128 bits) of each window of ``_rid, doc_id, text``."""
    lines = F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r")))
    places = F.when(F.size("l") >= WINDOW, F.sequence(F.lit(0), F.size("l") - WINDOW)).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: F.struct(i.alias("pos"), F.unhex(F.md5(F.array_join(F.slice("l", i + 1, WINDOW), "\n"))).alias("key")))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    out = rows.select("_rid", rank.alias("rank"), lines.alias("l")).select("_rid", "rank", F.explode(each).alias("w")).select("_rid", "rank", "w.pos", "w.key")
    return out.filter(F.col("key") != F.unhex(F.md5(F.lit("\n" * (WINDOW - 1)))))


def covered(found: DataFrame) -> DataFrame:
    """``_rid, start, stop``: the disjoint ranges of lines (both ends included) that later occurrences cover."""
    repeated = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rank", "_rid", "pos")).alias("first")).filter("n > 1").drop("n")
    later = found.join(repeated, "key").filter("_rid <> first._rid OR pos <> first.pos")
    start = F.when(F.col("_rid") == F.col("first._rid"), F.greatest("pos", F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    spans = later.select("_rid", start.cast("int").alias("start"), (F.col("pos") + WINDOW - 1).cast("int").alias("stop"))
    own = Window.partitionBy("_rid").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (F.coalesce(reach, F.lit(-2)) < F.col("start") - 1).cast("int")).withColumn("island", F.sum("new").over(own))
    return islands.groupBy("_rid", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def marked(rows: DataFrame, join=lambda rows, ranges: rows.join(ranges, "_rid", "left")) -> DataFrame:
    """``rows`` (as :func:`common.boxed` gives them) with ``removed_ranges`` (array of start and stop, null if none) and ``kept_text``."""
    # the windows are hashed twice, once to find the repeated ones and once to meet them, and nothing is written between
    ranges = covered(windows(rows)).groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed_ranges"))
    lines = F.col("_lines")
    cuts = F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"))), F.col("removed_ranges"), F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("stop"))))
    between = F.transform(
        F.sequence(F.lit(1), F.size("_cuts") - 1),
        lambda i: F.slice(lines, F.col("_cuts")[i - 1]["stop"] + 2, F.col("_cuts")[i]["start"] - F.col("_cuts")[i - 1]["stop"] - 1),
    )
    out = join(rows, ranges).withColumn("_lines", F.when(F.col("removed_ranges").isNotNull(), lines_of(F.col("text")))).withColumn("_cuts", cuts)
    kept = F.when(F.col("removed_ranges").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    return out.withColumn("kept_text", kept).drop("_cuts", "_lines")


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated lines taken out of ``text``; ``n_chars``, if there, is counted anew."""
    join = lambda rows, ranges: attached(rows, ranges, "line-ranges", lists="removed_ranges")
    return unboxed(marked(boxed(documents), join), F.col("kept_text"))


def report(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``removed`` (ranges as text) and ``kept_sha256`` of every document."""
    out = marked(boxed(documents).drop("_row"))
    ranges = F.coalesce(F.col("removed_ranges"), F.array().cast("array<struct<start:int,stop:int>>"))
    return out.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"] + 1).alias("n_removed"),
        F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",").alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


SQL = """
    WITH d AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
    ), line AS (
        SELECT doc_id, l, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos FROM d
    ), w AS (
        SELECT doc_id, pos, trim(l[pos + 1], ' ' || chr(9) || chr(13)) || chr(10) || trim(l[pos + 2], ' ' || chr(9) || chr(13)) || chr(10) || trim(l[pos + 3], ' ' || chr(9) || chr(13)) AS key
        FROM line WHERE pos + 3 <= len(l)
    ), f AS (
        SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM w WHERE key <> chr(10) || chr(10)
        WINDOW o AS (PARTITION BY key ORDER BY doc_id, pos)
    ), cover AS (
        SELECT DISTINCT doc_id, CAST(unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS INTEGER) AS pos
        FROM f WHERE doc_id <> fd OR pos <> fp
    ), island AS (
        SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM cover) GROUP BY doc_id, g
    ), gone AS (
        SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) AS r FROM island GROUP BY doc_id
    ), kept AS (
        SELECT line.doc_id, string_agg(line.l[line.pos + 1], chr(10) ORDER BY line.pos) AS t
        FROM line LEFT JOIN cover ON line.doc_id = cover.doc_id AND line.pos = cover.pos WHERE cover.pos IS NULL GROUP BY line.doc_id
    )
    SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, coalesce(gone.n, 0) AS n_removed, coalesce(gone.r, '') AS removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
