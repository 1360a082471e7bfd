"""Operator 7: toxicity by a weighted lexicon matched with Aho-Corasick.

Text is folded first: letters are lowered, look-alikes of other scripts, full-width forms
and digits or signs that stand for letters become that letter, everything else a blank.
Entries are words or beginnings of words; of several that match at a word the heaviest
counts, and hits inside exception phrases do not count.  The weights, their sum normalised
by length and the sum over different entries give a score between 0 and 1.

Exception phrases are two words, one of which an entry matches, that labelled clean documents hold
and toxic ones do not: they are learnt like the entries, and given ones may be added.

Weights are log-odds of an entry's document frequencies in labelled documents; the three
numbers of the last step are fitted by logistic regression on hits of a lexicon that did
not see the document.  The fit takes at most about SAMPLE_ROWS labelled documents, chosen
by a hash of their ids; what a document is scored by is its text alone.

Results: a null or empty text has no hits and the lowest score; without labels of both
classes every score is the smoothed share of toxic labels; contradicting labels of one id
count as toxic; repeated rows are scored each; very long texts are folded and matched like any
other, in time proportional to their length; an empty table gives an empty one; other columns
stay, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, stage, text_of, text_slices, unboxed

#: Labelled documents that a fit takes, about; with them its lexicon is bounded, too.
SAMPLE_ROWS = 20_000
SAMPLE_TASKS = 12
THRESHOLD = 0.7
#: Parts of the sample; each is matched with a lexicon of the others.
FOLDS = 4
#: Lengths of word beginnings that may become entries; the least log-odds of an entry.
PREFIXES, LEAST_WEIGHT = range(3, 9), 2.5
#: Clean documents that make a phrase of two words an exception, if no toxic one has it.
LEAST_CLEAN = 5

# Letters of other scripts that look like Latin ones, in pairs.
_ALIKE = "аaеeоoрpсcуyхxіiјjѕsԁdһhκkοoρpαaνvτtιiεeυuｏo"
# Digits and signs that stand for letters, in pairs.  l, 1 and | fold to i, as they cannot be told apart.
_SUBSTITUTES = "0o1i3e4a5s7tli|i"
_SIGNS = re.compile(r"[@$](?=[^\W\d_])")


#: Names of further characters that show one Latin letter.  Accented ones are letters of their languages and stay.
_NAMED = re.compile(r"(?:LATIN LETTER SMALL CAPITAL|.* SYMBOL LETTER|.*(?:SQUARED|CIRCLED) LATIN CAPITAL LETTER) ([A-Z])\Z")


def _letter(c: str) -> str:
    """The plain letter that a character shows: by the pairs, or by its name."""
    m = None if c in _PAIRS or c.isascii() else _NAMED.match(unicodedata.name(c, ""))
    return _PAIRS.get(c, m[1].lower() if m else c)


class _Folds(dict):
    """What each character folds to, found when it is first met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(map(_letter, c))
        self[code] = out = c if c.isalpha() else "" if unicodedata.category(chr(code)) in ("Cf", "Mn") else " "
        return out


_PAIRS = dict(zip(_ALIKE[::2], _ALIKE[1::2], strict=True)) | dict(zip(_SUBSTITUTES[::2], _SUBSTITUTES[1::2], strict=True))
_FOLDS = _Folds()


def fold(text: str) -> str:
    """Folded words with a blank before and after each."""
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + " ".join(text.translate(_FOLDS).split()) + " "


def entries(folded: str) -> set[str]:
    """The candidates in a folded text: ' word ' and ' beginning'."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def matcher(self):
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (entry, weight))
            for phrase in self.exceptions:
                p = phrase if phrase[:1] == " " else fold(phrase)
                a.add_word(p, (p, 0.0))
            if len(a):
                a.make_automaton()
            self.automaton = a
        return self.automaton

    def hits(self, folded: str) -> tuple[dict[int, tuple[float, str]], list[tuple[int, int]]]:
        """The heaviest entry at each word that has any, by its place, and the ranges of exception phrases."""
        best: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        a = self.matcher()
        for end, (entry, weight) in a.iter(folded) if len(a) else ():
            start = end - len(entry) + 1
            if weight == 0.0:
                excused.append((start, end))
            elif weight > best.get(start, (0.0, ""))[0]:
                best[start] = (weight, entry)
        return best, excused

    def features(self, text: str) -> tuple[float, float]:
        """Weight by length and weight of different entries, both as logarithms."""
        folded = fold(text)
        best, excused = self.hits(folded)
        if excused and best:
            places = sorted(best)
            for first, last in excused:  # each looks at the few hits that it holds
                i = bisect_left(places, first)
                while i < len(places) and places[i] < last:
                    best.pop(places[i], None)
                    i += 1
        total = sum(w for w, _ in best.values())
        different = {entry: w for w, entry in best.values()}
        return math.log1p(100 * total / (folded.count(" ") + 20)), math.log1p(sum(different.values()))

    def phrases(self, text: str) -> set[str]:
        """The pairs of words around each hit, as exceptions are written."""
        folded = fold(text)
        best, _ = self.hits(folded)
        if not best:
            return set()
        words = folded.split()
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        out = set()
        for place in best:
            i = int(np.searchsorted(starts, place))
            out |= {f" {words[j]} {words[j + 1]} " for j in (i - 1, i) if 0 <= j < len(words) - 1}
        return out

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        x, y = self.features(text)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def least_documents(n_toxic: int) -> int:
    """Toxic documents that an entry needs."""
    return max(3, math.ceil(0.008 * n_toxic))


def weigh(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The entries worth keeping with their log-odds.

    A beginning goes where one longer entry stands for nearly all of its documents; an
    entry goes where a shorter one that stays says as much.
    """
    least = least_documents(n_toxic)
    odds = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean[e] + 0.5) / (n_clean + 1)) for e, n in toxic.items() if n >= least}
    kept = {e: w for e, w in odds.items() if w >= LEAST_WEIGHT}
    largest: Counter = Counter()  # of each beginning, the documents of its most frequent longer entry
    for e in kept:
        for s in shorter(e):
            largest[s] = max(largest[s], toxic[e])
    kept = {e: w for e, w in kept.items() if largest[e] < 0.9 * toxic[e]}
    for e in sorted(kept, key=len, reverse=True):
        if any(kept.get(s, 0.0) >= kept[e] for s in shorter(e)):
            del kept[e]
    return dict(sorted(kept.items()))


def shorter(entry: str) -> list[str]:
    """The beginnings that match wherever ``entry`` does, without itself."""
    word = entry.strip()
    return [s for n in PREFIXES if n <= len(word) and (s := f" {word[:n]}") != entry]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, ...]:
    """Coefficients by Newton's method, the intercept first."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(beta)) * penalty * len(x) * 0.01 + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty * len(x) * 0.01 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def held_out(doc_id) -> object:
    """Rows that no fit may see: the checksum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text``, ``toxic`` and ``fold`` of at most about ``rows`` labelled documents that may be learnt from."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    number = usable.count()
    million = 1_000_000
    share = million if number <= rows else math.ceil(million * rows / number)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(million)) < share)
    chosen = chosen.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # the chosen ids are bounded by ``rows``, whatever the size of the tables
    joined = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # copies of one document, near ones for the most part, count once: they share their least shingle
    words = joined.withColumn("w", F.split(F.lower("text"), r"\s+"))
    places = F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)))
    least = F.array_min(F.transform(places, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    once = words.withColumn("least", least).drop("w").groupBy("toxic", "least").agg(F.min("text").alias("text"))
    # few tasks, as ``rows`` bounds them: what each counts by entry it need not send one by one
    return stage(once.select("text", "toxic", F.pmod("least", F.lit(FOLDS)).cast("int").alias("fold")).coalesce(SAMPLE_TASKS), "labelled")


def _counts(rows: DataFrame, things, least: int) -> dict[int, Counter]:
    """Documents by thing (what ``things`` finds in a text) and fold, of things that ``least`` of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, part in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                found.update((e, part) for e in things(text))
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([p for _, p in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["entry", "fold", "n"])

    summed = rows.select("text", "fold").mapInArrow(run, "entry string, fold int, n long").groupBy("entry").pivot("fold", list(range(FOLDS))).agg(F.sum("n")).na.fill(0)
    out: dict[int, Counter] = {f: Counter() for f in range(FOLDS)}
    total = sum((F.col(str(f)) for f in range(FOLDS)), F.lit(0))
    for entry, *counts in summed.filter(total >= least).toLocalIterator():
        for f, n in enumerate(counts):
            out[f][entry] = n
    return out


def exceptions_of(toxic: Counter, clean: Counter) -> tuple[str, ...]:
    """Phrases around hits that enough clean documents have and no toxic one."""
    return tuple(sorted(p for p, n in clean.items() if n >= LEAST_CLEAN and not toxic[p]))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon with its weights, exceptions (besides those given) and coefficients, from the labels of rows that are not held out."""
    taken = sample(documents, labels, rows)
    sizes = {(t, f): n for t, f, n in taken.groupBy("toxic", "fold").count().collect()}
    n_toxic, n_clean = ([sizes.get((t, f), 0) for f in range(FOLDS)] for t in (1, 0))
    total = sum(n_toxic) + sum(n_clean)
    if not sum(n_toxic) or not sum(n_clean):
        return Lexicon({}, exceptions, constant=(sum(n_toxic) + 0.5) / (total + 1) if total else 0.0)
    bad, good = taken.filter("toxic = 1"), taken.filter("toxic = 0")
    toxic = _counts(bad, lambda text: entries(fold(text)), 2)
    all_toxic = sum(toxic.values(), Counter())
    bar = least_documents(sum(n_toxic) - max(n_toxic))
    wanted = frozenset(e for e, n in all_toxic.items() if n >= bar)
    clean = _counts(good, lambda text: entries(fold(text)) & wanted, 1)
    all_clean = sum(clean.values(), Counter())
    whole = Lexicon(weigh(all_toxic, all_clean, sum(n_toxic), sum(n_clean)))
    around = [_counts(part, whole.phrases, least) for part, least in ((bad, 1), (good, 1))]
    all_around = [sum(found.values(), Counter()) for found in around]
    whole = Lexicon(whole.weights, exceptions + exceptions_of(*all_around))
    parts = [
        Lexicon(weigh(all_toxic - toxic[f], all_clean - clean[f], sum(n_toxic) - n_toxic[f], sum(n_clean) - n_clean[f]), exceptions + exceptions_of(*(a - found[f] for a, found in zip(all_around, around, strict=True))))
        for f in range(FOLDS)
    ]
    held = taken.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value[f].features(t) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch.column("toxic")], names=["x", "y", "toxic"])

    seen = taken.mapInArrow(run, "x double, y double, toxic int").toArrow()
    x = np.column_stack((seen.column("x").to_numpy(), seen.column("y").to_numpy()))
    whole.coefficients = logistic(x, seen.column("toxic").to_numpy().astype(float))
    return whole


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` (0 to 1)."""
    kept = [c for c in documents.columns if c != "score"]
    rows = documents.select(*kept)
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, score double"
    held = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                found = [held.value.score(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, "score"])

    return rows.mapInArrow(run, schema)


def judged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    out = score(documents.select("doc_id", text_of().alias("text")), fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without those that score ``threshold`` or more."""
    return unboxed(score(boxed(documents), lexicon).filter(F.col("score") < threshold))
