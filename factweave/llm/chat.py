"""Operator 10: transcript parsing by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines.  The hidden state of a line is the role that speaks and
whether the line begins a turn.  Lines are observed through the speaker marker at their head, if
there is one, and through features: an empty line before, the length, a question at the end.
Probabilities are counted on a bounded sample of conversations whose roles are known; a turn goes
on in its own role, and a conversation begins with a turn.  Viterbi finds the states, lines from
one beginning to the next are a turn, and turns are rendered in one canonical form.

:func:`flattened` makes transcripts of a table of turns: turns follow each other, an empty line
between them, most with one of many markers, one in HIDDEN without any.  The given roles enter the
text of these markers and the counts of the fit, and nothing else.

Lines are laid out in order of conversation and turn and read batch by batch; a conversation that
crosses the end of a batch is cut into segments, each reduced to the best path between every pair
of states around it, and the segments are joined by a max-plus product.  So one conversation may
hold any share of all rows, and the result is the same as in one piece.

Results: null texts are empty; turns of unknown or null roles have no marker, and without a text
they leave no line; null conversation ids form one conversation; null turns come first; repeated
rows follow each other; very long texts are many lines, a very long line is one; an empty table
gives an empty one; other columns, whatever their names, are not read.  Control tokens inside a text
are broken up before rendering.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage, text_of, with_row_id

ROLES = ("system", "user", "assistant", "tool")
#: What speakers are called, by role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "answer", "a", "agent", "chatbot"),
    "tool": ("tool", "function", "observation", "ipython"),
}
#: How a marker may stand at the head of a turn; one turn in so many has none.
FRAMES, HIDDEN = ("{}: ", "[{}] ", "**{}:** ", "### {}:\n", "<|{}|>\n", "{}> "), 4
#: Conversations that the fit takes at most, about, by a hash of their ids.
SAMPLE_CONVERSATIONS = 50_000
#: Classes of length (powers of two).  States: a role that begins a turn, a role that goes on.
LENGTHS, STATES = 24, 2 * len(ROLES)
#: Share that the expectation of a feature has in its probabilities, so that classes a state was hardly met with do not decide.
PRIOR = 0.1
_NEVER = -1e9

_NAMES = "|".join(sorted((n for names in MARKERS.values() for n in names), key=len, reverse=True))
#: A marker at the head of a line: an optional frame, the name, and a sign that ends it.
HEAD = rf"^\s*(?:<\|(?:im_start\|>)?|\[|\*\*|#{{1,3}} )?\s*(?i:({_NAMES}))\s*(?:\d*\s*)(?:\|>|\]\s*:?|:\s*\*\*|\*\*\s*:?|:|>)[ \t]*"
#: Features, with the number of their classes; a marker's class is 0 for none, else the role's number from 1.
FEATURES = {"marker": len(ROLES) + 1, "gap_before": 2, "length": LENGTHS, "question": 2}


def _marker_prior() -> np.ndarray:
    """What markers are expected before any are counted: a beginning has its role's marker or none, a line that goes on has none."""
    out = np.full((STATES, len(ROLES) + 1), 0.01)
    for state in range(STATES):
        role, goes_on = divmod(state, 2)
        out[state, 0] = 1.0 if goes_on else 1 / HIDDEN
        out[state, role + 1] += 0.0 if goes_on else 1 - 1 / HIDDEN
    return out / out.sum(1, keepdims=True)


def _mixed(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The shares that were counted, mixed with what is expected; states that were not met have the latter alone."""
    n = counts.sum(1, keepdims=True)
    return np.where(n > 0, (1 - PRIOR) * counts / np.maximum(n, 1) + PRIOR * expected, expected)


def _alike(counts: np.ndarray) -> np.ndarray:
    """For each state the share of each class over all states that begin a turn as it does, or go on as it does."""
    kinds = np.stack([counts[k::2].sum(0) + 1 for k in (0, 1)])
    return (kinds / kinds.sum(1, keepdims=True))[np.arange(STATES) % 2]


@dataclass
class Model:
    """Log-probabilities: of starts, of steps, and of each feature's classes by state."""

    start: np.ndarray
    step: np.ndarray
    features: dict[str, np.ndarray]

    @classmethod
    def counted(cls, start: np.ndarray, step: np.ndarray, features: dict[str, np.ndarray]) -> Model:
        logs = lambda c: np.log((c + 0.5) / (c + 0.5).sum(-1, keepdims=True))
        state = np.arange(STATES)
        goes_on, role = state % 2 == 1, state // 2
        first, steps = logs(start), logs(step)
        first[goes_on] = _NEVER
        steps[(role[:, None] != role[None, :]) & goes_on[None, :]] = _NEVER
        return cls(first, steps, {name: np.log(_mixed(c, _marker_prior() if name == "marker" else _alike(c))) for name, c in features.items()})

    def emissions(self, observed: dict[str, np.ndarray], markers: bool) -> np.ndarray:
        """Scores of each line's features in each state; without ``markers``, of the others."""
        return sum(table[:, observed[name]].T for name, table in self.features.items() if markers or name != "marker")


def viterbi(first: np.ndarray, step: np.ndarray, emissions: np.ndarray) -> np.ndarray:
    """The best paths of several sequences of equal length, from (sequences, lines, states) to (sequences, lines)."""
    score = first + emissions[:, 0]
    back = np.zeros(emissions.shape, np.int8)
    for t in range(1, emissions.shape[1]):
        ways = score[:, :, None] + step
        back[:, t] = ways.argmax(1)
        score = ways.max(1) + emissions[:, t]
    path = np.empty(emissions.shape[:2], np.int64)
    path[:, -1] = score.argmax(1)
    every = np.arange(len(path))
    for t in range(emissions.shape[1] - 1, 0, -1):
        path[:, t - 1] = back[every, t, path[:, t]]
    return path


def between(step: np.ndarray, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every first and last state of a segment the best score, and the states on that path as (lines, first * STATES + last)."""
    n, rows = len(step), len(emissions)
    score = np.where(np.eye(n, dtype=bool), 0.0, -1e300) + emissions[0]
    back = np.zeros((rows, n, n), np.int8)
    for t in range(1, rows):
        ways = score[:, :, None] + step
        back[t] = ways.argmax(1)
        score = ways.max(1) + emissions[t]
    paths = np.empty((rows, n, n), np.int8)
    paths[-1] = np.arange(n)
    for t in range(rows - 1, 0, -1):
        paths[t - 1] = np.take_along_axis(back[t], paths[t].astype(np.int64), 1)
    return score, paths.reshape(rows, n * n)


def stitched(model: Model, segments: list[np.ndarray]) -> list[int]:
    """For each segment of one conversation, in order, the index of its pair of first and last state."""
    n = len(model.start)
    ways = model.start[:, None] + segments[0]
    score, entry = ways.max(0), [np.argmax(ways, 0)]
    befores = [np.zeros(n, int)]
    for s in segments[1:]:
        into = score[:, None] + model.step
        origin, arrive = into.argmax(0), into.max(0)
        ways = arrive[:, None] + s
        entry.append(np.argmax(ways, 0))
        befores.append(origin)
        score = ways.max(0)
    last, out = int(score.argmax()), []
    for e, before in zip(reversed(entry), reversed(befores), strict=True):
        first = int(e[last])
        out.append(first * n + last)
        last = int(before[first])
    return out[::-1]


def role_of(name: Column) -> Column:
    """The number of the role that a name stands for, null if none."""
    name, out = F.lower(F.btrim(name.cast("string"))), F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        out = F.when(name.isin(*MARKERS[r]), F.lit(i)).otherwise(out)
    return out


def split_lines(rows: DataFrame) -> DataFrame:
    """The lines of ``text`` that are not empty: all other columns, ``line``, ``raw`` and ``gap``, the empty lines before (one before the first)."""
    lines = rows.withColumn("_l", F.split("text", "\n", -1)).withColumn("_i", F.filter(F.transform("_l", lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull()))
    each = F.transform("_i", lambda i, k: F.struct(k.alias("line"), F.get("_l", i).alias("raw"), F.when(k == 0, F.lit(1)).otherwise(i - F.get("_i", k - 1) - 1).alias("gap")))
    return lines.select(*(c for c in rows.columns if c != "text"), F.inline(each))


def flattened(conversations: DataFrame) -> DataFrame:
    """The transcripts of a table of turns, piece by piece: ``conv_id, turn, _rid, role`` of the turn and its ``text`` as it stands there."""
    prepare(conversations.sparkSession)
    rows = with_row_id(conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text_of().alias("text")))
    number = role_of(F.col("role"))
    pick = F.xxhash64("conv_id", "turn", "text")
    names = F.element_at(F.array(*(F.array(*map(F.lit, MARKERS[r])) for r in ROLES)), number + 1)
    name = F.get(names, F.pmod(F.shiftright(pick, 8), F.size(names)).cast("int"))
    shown = F.element_at(F.array(*(F.concat(F.lit(f.split("{}")[0]), F.initcap(name), F.lit(f.split("{}")[1])) for f in FRAMES)), (F.pmod(F.shiftright(pick, 24), F.lit(len(FRAMES))) + 1).cast("int"))
    marked = number.isNotNull() & ((F.pmod(pick, F.lit(HIDDEN)) != 0) | (F.btrim("text", F.lit(" \t\r\n")) == ""))
    return rows.withColumn("text", F.when(marked, F.concat(shown, "text")).otherwise(F.col("text")))


def from_transcripts(transcripts: DataFrame, id_column: str = "conv_id", text: str = "text") -> DataFrame:
    """Flat transcripts, one a row, as :func:`flattened` gives their pieces."""
    rows = with_row_id(transcripts.select(F.col(id_column).alias("conv_id"), F.lit(0).cast("long").alias("turn"), text_of(text).alias("text"), F.lit(None).cast("string").alias("role")))
    return rows.select("conv_id", "turn", "_rid", "role", "text")


def laid_out(pieces: DataFrame) -> DataFrame:
    """The lines in order, with their features and ``truth``, the state that the given role tells; staged, so that what follows finds them in place.

    Pieces are put in order before they are cut into lines, which keeps it.
    """
    order = ("conv_id", "turn", "_rid")
    lines = split_lines(pieces.repartitionByRange(*order).sortWithinPartitions(*order))
    body = F.btrim(F.regexp_replace("raw", HEAD, ""), F.lit(" \t\r"))
    size = F.least(F.floor(F.log2(F.length("body") + 1)), F.lit(LENGTHS - 1))
    out = lines.withColumn("body", body).withColumns({
        "marker": F.coalesce(role_of(F.regexp_extract("raw", HEAD, 1)) + 1, F.lit(0)),
        "gap_before": (F.col("gap") > 0).cast("int"),
        "length": size.cast("int"),
        "question": F.col("body").endswith("?").cast("int"),
        "truth": 2 * role_of(F.col("role")) + (F.col("line") > 0).cast("int"),
    }).drop("raw")
    return stage(out.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "lines")


def runs(batch: pa.RecordBatch) -> list[tuple[int, int, bool]]:
    """The bounds of each run of one conversation in a batch; true where it may go on elsewhere."""
    codes = pd.factorize(batch.column("conv_id").to_pandas(), use_na_sentinel=False)[0]
    part = batch.column("_part").to_numpy()
    broken = part[1:] != part[:-1]
    bounds = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | broken) + 1).tolist(), len(part)]
    open_at = {0, len(part), *(np.flatnonzero(broken) + 1).tolist()}
    return [(a, b, a in open_at or b in open_at) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fit(lines: DataFrame, conversations: int = SAMPLE_CONVERSATIONS) -> Model:
    """Counts over a sample of conversations; steps are counted between neighbours in place."""
    known = lines.filter("truth IS NOT NULL")
    number = known.agg(F.approx_count_distinct("conv_id")).first()[0]
    million = 1_000_000
    share = million if number <= conversations else math.ceil(million * conversations / number)
    taken = lines.filter(F.pmod(F.xxhash64("conv_id"), F.lit(million)) < share)
    n = STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n + 1, n), np.int64)  # the last row holds starts
        for batch in batches:
            truth = batch.column("truth").to_numpy(zero_copy_only=False) if batch.num_rows else ()
            for a, b, _ in runs(batch) if batch.num_rows else ():
                states = np.nan_to_num(np.asarray(truth[a:b], float), nan=-1).astype(int)
                both = (states[1:] >= 0) & (states[:-1] >= 0)
                np.add.at(counts, (states[:-1][both], states[1:][both]), 1)
                if a and states[0] >= 0:  # a run that begins inside a batch begins its conversation
                    counts[n, states[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range((n + 1) * n)), pa.array(counts.ravel())], names=["cell", "n"])

    counts = np.zeros((n + 1, n))
    for cell, count in taken.select("conv_id", "_part", "truth").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[divmod(cell, n)] += count
    features = {name: np.zeros((n, classes)) for name, classes in FEATURES.items()}
    # at most states * classes rows, whatever the size of the table
    for truth, *values, rows in taken.filter("truth IS NOT NULL").groupBy("truth", *FEATURES).count().collect():
        for (name, table), value in zip(features.items(), values, strict=True):
            table[truth, value] += rows
    return Model.counted(counts[n], counts[:n], features)


def decoded(lines: DataFrame, model: Model) -> DataFrame:
    """``lines`` with ``state`` (markers and features), ``blind`` (features alone) and ``start``, the place of the line that begins the turn."""
    held = lines.sparkSession.sparkContext.broadcast(model)
    fields = [c for c in lines.columns if c not in (*FEATURES, "truth")]
    schema = f"{', '.join(f'`{c}` {t}' for c, t in lines.dtypes if c in fields)}, state int, blind int, start long, ways binary, joint array<double>, segment string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, task = held.value, TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            observed = {name: batch.column(name).to_numpy() for name in FEATURES}
            kinds = [m.emissions(observed, markers) for markers in (True, False)]
            states, inside = [np.zeros(rows, np.int64) for _ in kinds], np.ones(rows, bool)
            ways: list[bytes | None] = [None] * rows
            joints: list[list[float] | None] = [None] * rows
            names: list[str | None] = [None] * rows
            by_length: dict[int, list[int]] = {}
            for a, b, edge in runs(batch):
                if not edge:
                    by_length.setdefault(b - a, []).append(a)
                    continue
                (s1, p1), (s2, p2) = (between(m.step, e[a:b]) for e in kinds)
                inside[a:b] = False
                ways[a:b] = [r.tobytes() for r in np.concatenate((p1, p2), 1).astype(np.uint8)]
                joints[a] = [*s1.ravel().tolist(), *s2.ravel().tolist()]
                names[a:b] = [f"{task}-{number}-{a}"] * (b - a)
            for length, begins in by_length.items():
                at = np.array(begins)[:, None] + np.arange(length)
                for out, e in zip(states, kinds, strict=True):
                    out[at] = viterbi(m.start, m.step, e[at])
            place = batch.column("_at").to_numpy()
            begun = np.maximum.accumulate(np.where(inside & (states[0] % 2 == 0), np.arange(rows), 0))
            found = [pa.array(states[0], pa.int32(), mask=~inside), pa.array(states[1], pa.int32(), mask=~inside), pa.array(place[begun], pa.int64(), mask=~inside)]
            more = [pa.array(ways, pa.binary()), pa.array(joints, pa.list_(pa.float64())), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), *found, *more], names=[*fields, "state", "blind", "start", "ways", "joint", "segment"])

    found = stage(lines.drop("truth").mapInArrow(run, schema), "decoded")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at")
        joint = np.array(group["joint"].tolist()).reshape(len(group), 2, STATES, STATES)
        return pd.DataFrame({"segment": group["segment"], "pair": stitched(held.value, list(joint[:, 0])), "blind_pair": stitched(held.value, list(joint[:, 1]))})

    # two rows for each batch at most, whatever the length of a conversation
    pairs = found.filter("joint IS NOT NULL").select("conv_id", "_at", "joint", "segment").groupBy("conv_id").applyInPandas(join, "segment string, pair int, blind_pair int")
    at = lambda i: F.conv(F.hex(F.expr(f"substring(ways, {i} + 1, 1)")), 16, 10).cast("int")
    cells = STATES**2
    outer = found.filter("segment IS NOT NULL").drop("state", "blind", "start").join(pairs, "segment")
    outer = outer.select(*fields, at("pair").alias("state"), at(f"{cells} + blind_pair").alias("blind"))
    inner = found.filter("segment IS NULL").select(*fields, "state", "blind", "start")
    return inner.unionByName(_begun(outer, fields))


def _begun(lines: DataFrame, fields: list[str]) -> DataFrame:
    """``lines`` with ``start``: the last beginning of a turn at or before each, in its conversation, whose parts are looked at one by one."""
    begins = F.when(F.col("state") % 2 == 0, F.col("_at"))
    own = Window.partitionBy("conv_id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("start", F.last(begins, ignorenulls=True).over(own))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    lasts = lines.groupBy("conv_id", "_part").agg(F.max(begins).alias("last")).select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), F.last("last", ignorenulls=True).over(before).alias("_before"))
    out = [*fields, "state", "blind", "start"]
    ahead = rows.filter("start IS NULL").join(lasts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")), "left").withColumn("start", F.coalesce("_before", "_at"))
    return rows.filter("start IS NOT NULL").select(*out).unionByName(ahead.select(*out))


def role_name(state: Column) -> Column:
    return F.element_at(F.array(*(F.lit(r) for r in ROLES)), F.floor(state / 2).cast("int") + 1)


def rendered(role: Column, body: Column) -> Column:
    """``<|im_start|>role``, the text, ``<|im_end|>``; such tokens inside the text are broken up."""
    safe = F.regexp_replace(body, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def turns_of(lines: DataFrame) -> DataFrame:
    """The turns that decoded lines make up.

    ``conv_id``; ``turn`` and ``role`` as given for the first line; ``parsed_role``; ``blind_role``, found without
    markers; ``n_lines``; ``n_given``, how many given turns its lines come from (one where all is right); ``rendered``.
    """
    grouped = lines.groupBy("start").agg(
        F.sort_array(F.collect_list(F.struct("_at", "gap", "body"))).alias("l"),
        F.min_by(F.struct("conv_id", "turn", "role", "state", "blind"), "_at").alias("first"),
        F.count_if((F.col("line") == 0) | (F.col("_at") == F.col("start"))).alias("n_given"),
    )
    pieces = F.transform("l", lambda x, i: F.when(i == 0, x["body"]).otherwise(F.concat(F.repeat(F.lit("\n"), x["gap"] + 1), x["body"])))
    parsed = role_name(F.col("first.state"))
    text = F.btrim(F.array_join(pieces, ""), F.lit(" \t\r\n"))
    return grouped.select("first.conv_id", "first.turn", "first.role", parsed.alias("parsed_role"), role_name(F.col("first.blind")).alias("blind_role"), F.size("l").cast("long").alias("n_lines"), "n_given", rendered(parsed, text).alias("rendered"))


def parse(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """The turns found in the transcripts of ``conversations``; see :func:`turns_of`."""
    lines = laid_out(flattened(conversations))
    return turns_of(decoded(lines, model or fit(lines)))


def parse_transcripts(transcripts: DataFrame, model: Model, id_column: str = "conv_id", text: str = "text") -> DataFrame:
    """The turns found in flat transcripts, by a model that was fitted elsewhere."""
    return turns_of(decoded(laid_out(from_transcripts(transcripts, id_column, text)), model))


__all__ = ["HEAD", "Model", "between", "decoded", "fit", "flattened", "from_transcripts", "laid_out", "parse", "parse_transcripts", "stitched", "turns_of", "viterbi"]
